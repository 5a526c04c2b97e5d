"""Token-ID files: planes, files and the whole operator against brute force and exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from densel.llm import token_files as T
from densel.session import scratch_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDWISE, WHOLE = T.Encoder(PATH, 2), T.Encoder(PATH, 2, whole=True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, kind):
    block = np.array(ids, np.uint32)
    planes = T.to_planes(block, kind)
    assert np.array_equal(T.from_planes(planes, len(block), kind), block)
    if kind == "bit" and ids:
        assert len(planes) == max(ids).bit_length()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_round_trip_and_damage(kind):
    docs = [(None, [7]), (-3, []), (5, list(range(1000))), (5, [2**32 - 1, 0])]
    w = T.FileWriter(4, kind, block=64)
    frames = [f for k, ids in docs for f in w.add(k, np.array(ids, np.uint32))] + w.close()
    content = b"".join(f + T.MARK for f in frames)
    facts, nulls, keys, counts, chunks = T.read_file(memoryview(content))
    assert (facts["place"], facts["n_ids"], facts["block"]) == (4, 1003, 64)
    assert nulls.tolist() == [True, False, False, False] and keys[1:].tolist() == [-3, 5, 5]
    assert counts.tolist() == [1, 0, 1000, 2]
    assert np.concatenate(list(chunks)).tolist() == [7, *range(1000), 2**32 - 1, 0]
    with pytest.raises(ValueError):
        T.read_file(memoryview(content[:-1]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged = bytearray(content)
        damaged[20] ^= 255
        list(T.read_file(memoryview(bytes(damaged)))[4])


def test_one_chunk_alone():
    w = T.FileWriter(0, "bit", block=10)
    frames = w.add(1, np.arange(35, dtype=np.uint32)) + w.close()
    content = b"".join(f + T.MARK for f in frames)
    at = T.FOOTER.unpack_from(content, len(content) - T.FOOTER.size - 4)
    index = content[at[2]:at[2] + at[3]]
    assert next(T.read_chunks(memoryview(content), index, "bit", first=2)).tolist() == list(range(20, 30))


PIECES = ["a", "Be", "É", "é", "́", " ", "\t", "\xa0", " ", ".", ",", "'s", "'S", "!?", "<|endoftext|>",
          "<|ENDOFTEXT|>", "<|", "Σ", "İ", "1", "２", "\x1c", "\x85", "中", "😀", "‍", "\n", "ﬁ", "K", '"', "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_words_encode_as_whole_texts(parts):
    text = "".join(parts).encode()
    assert WORDWISE(text).tolist() == WHOLE(text).tolist()


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(T, "WORDS_HELD", 8)
    e, whole = T.Encoder(PATH, None), T.Encoder(PATH, None, whole=True)
    text = b"one two three four five six seven eight nine ten one two three one nine"
    assert e(text).tolist() == whole(text).tolist() and e(text).tolist() == whole(text).tolist()


def expected(rows):
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, table, **options):
    path = scratch_dir(spark, "ids")
    n = T.write_ids(table, path, PATH, end_id=2, **options)
    out = T.positions(spark, path, n, F.crc32("ids").alias("crc"))
    return [tuple(r) for r in out.select("doc_id", "start", "n_tokens", "crc").collect()]


@pytest.mark.parametrize("options", [{}, {"planes": "byte", "block": 50}, {"block": 7, "whole": True}])
def test_operator_is_exact(spark, options):
    texts = ["Hello, world's end. <|endoftext|>", "", None, "é" * 500, "long text " * 4000, "tie", "tie", "Zażółć 中文 gęślą"]
    rows = [((i * 37) % 101 - 50, texts[i % len(texts)]) for i in range(60)] + [(None, "no key")]
    table = docs(spark, rows).withColumn("ids", F.lit(1)).withColumn("place", F.lit("x")).withColumn("start", F.lit(2))
    assert sorted(run(spark, table, **options), key=str) == sorted(expected(rows), key=str)


def test_repeated_rows_and_keys(spark):
    rows = [(3, "same"), (3, "same"), (3, "other words here"), (1, "first"), (9, None)]
    got = sorted(run(spark, docs(spark, rows)), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 3, 3, 3, 9]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert sorted(r[3] for r in got) == sorted(r[3] for r in expected(rows))


def test_empty_table(spark):
    assert run(spark, docs(spark, [(1, "x")]).filter("false")) == []
