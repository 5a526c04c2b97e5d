"""Phrase collocations against brute force: pieces, langs, cuts, covered phrases, filters with false alarms."""

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from helpers import LOWER

from densel.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, f int, n string, phrase string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", "y") for i, (t, lang) in enumerate(rows)], SCHEMA)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, support=30, percent=80, top=2000, max_words=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    cands = {g: a for g, a in f.items() if a >= support and len(g[1]) >= 2}
    out = {}
    for (lang, g), a in cands.items():
        inside = any(100 * b >= percent * a and lang == lg and len(h) > len(g)
                     and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (lg, h), b in cands.items())
        if inside:
            continue
        cuts = [(2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top]))


def got(spark, rows, **options):
    return sorted(tuple(r) for r in P.collocations(table(spark, rows), **options).collect())


def corpus(seed, n=400):
    r = random.Random(seed)
    words = ["New", "york", "city", "hall", "é", "Été", "the", "of", "a", "b-c", "x\xa0y", "to", "be"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 30)):
            parts.append(r.choice(["New York City", "to be or not", "b b b b", r.choice(words), r.choice(words)]))
            parts.append(r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\r\n", "!"]))
        out.append(("".join(parts), r.choice(["en", "fr", None, "und"])))
    return out


@pytest.mark.parametrize("support,percent,top", [(30, 80, 2000), (7, 100, 5), (1, 50, 10_000)])
def test_collocations_are_exact(spark, support, percent, top):
    rows = corpus(support)[:60 if support == 1 else 400] + [(None, "en"), ("", "fr"), ("New York City " * 3000, "en"), ("word", None)]
    want = brute(rows, support, percent, top)
    assert len(want) > 10
    assert got(spark, rows, support=support, percent=percent, top=top) == want


def test_false_alarms_of_the_filter_change_nothing(spark, monkeypatch):
    rows = corpus(5, 200)
    full = P.zlib.compress(b"\xff" * (P.FILTER_BITS // 8))
    monkeypatch.setattr(P, "mine_shards", lambda rows, max_words, support: [full] * max_words)
    assert got(spark, rows, support=9) == brute(rows, 9)


def test_memory_of_the_last_count_is_bounded():
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(200_000)}" for _ in range(300)) for _ in range(6_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 500), pa.array([t.encode() for t in texts[i:i + 500]], pa.binary())],
                                          names=["lang", "text"]) for i in range(0, len(texts), 500)]
    told = SimpleNamespace(value=[P.zlib.compress(b"\xff" * (P.FILTER_BITS // 8))] * 2)
    tracemalloc.start()
    try:
        n = sum(sum(b.column(2).to_pylist()) for b in P._count(told, iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 6_000 * (300 + 300 + 299)  # all words of the lang, words, pairs
    assert peak < 400 << 20, peak


def test_no_frequent_phrase_and_empty(spark):
    assert got(spark, [("one two three", "en"), (None, None)]) == []
    assert P.collocations(table(spark, [("x", "en")]).filter("false")).collect() == []


def test_big_counts_do_not_overflow(spark):
    big = 4_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 3), ("en", "b", 1, big)],
                                   "lang string, phrase string, n_words int, f long")
    row = P.score(counts).first()
    assert (row["l"], row["r"], row["score"]) == (big + 3, big, 2000000 * big // (2 * big + 3))


def test_rank_ties_by_bytes(spark):
    rows = [(f"{a} {b}", "en") for a, b in (("z", "y"), ("é", "q"), ("a", "￿"), ("a", "😀")) for _ in range(30)]
    assert [r[2] for r in got(spark, rows)] == [r[2] for r in brute(rows)]
