"""Spelling variants: the bit-sliced index and the whole operator against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import LOWER, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from densel.llm import spelling as S


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(words, factor=10):
    form, rows = {}, {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        best = close[0] if close and -close[0][0] >= factor * n else None
        form[w] = best[1] if best else None
        rows[w] = (n, len(close), -best[0] if best else None)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), *[-1 if v is None else v for v in r]) for w, r in rows.items())


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"])
                  for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 9).flatmap(lambda m: st.tuples(
    st.just(m), st.lists(st.text("abÿ", min_size=m, max_size=m), min_size=1, max_size=40, unique=True),
    st.lists(st.text("abÿ", min_size=m - 1, max_size=m), min_size=1, max_size=90, unique=True))))
def test_block_finds_each_pair_once(case):
    m, queries, indexed = case
    found = Counter()
    for side in ("first", "last"):
        for i, j in S.near_pairs([q.encode("latin-1") for q in queries], [w.encode("latin-1") for w in indexed], m, side):
            found.update((queries[a], indexed[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert found == Counter((q, w) for q in queries for w in indexed if near(q, w))


def random_words(seed, n, letters="abcde"):
    r, out = random.Random(seed), {}
    base = ["".join(r.choices(letters, k=r.randint(7, 12))) for _ in range(max(1, n // 6))]
    while len(out) < n:
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(w))
            w[at:at + 1] = r.choice(["", r.choice(letters), w[at] + r.choice(letters)])
        w = "".join(w)
        if len(w) >= 3:
            out[w] = r.choice([2, 2, 3, 20, 25, 200, 2500])
    return out


@pytest.mark.parametrize("block,hot", [(4096, 32768), (8, 16), (2, 5)])
def test_variants_are_exact(spark, monkeypatch, block, hot):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "HOT_BLOCK", hot)
    monkeypatch.setattr(S.F, "greatest", lambda a, b: b)  # lets blocks be smaller than 64 words
    words = random_words(block, 250) | {"x" * 400: 2, "x" * 399: 40, "ééééééé": 3, "éééééé": 30, "ÿÿÿÿÿÿÿÿ": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(S.variants(df)) == expected(words)


def test_long_chains_reach_their_last_form(spark):
    words = {"aaaaaaaaaa"[:i] + "b" * (20 - i): 2 * 10 ** i for i in range(9)}
    rows = expected(words)
    assert {r[2] for r in rows} == {"aaaaaaaabbbbbbbbbbbb"}
    assert got(S.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == rows


def brute_words(rows, noise=31):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_operator_over_documents(spark):
    r = random.Random(3)
    some = ["Language", "languages", "LANGUAGE", "mißverständnis", "ÉCOLÈRE", "écolère", "naïveté", "a×b÷cdefg", "short",
            "x" * 9, "über-wörtlich", "tokenisation", "tokenization", "中文language", "àéîõüýÿ", "Ĳlanguage"]
    rows = [(i % 97 if i else None, " ".join(r.choices(some, k=40)) + r.choice(["", ".", "\n\x00"])) for i in range(300)]
    rows += [(5, None), (6, ""), (7, "language" * 2000), (7, "language" * 2000)]
    words = brute_words(rows)
    assert len(words) > 30
    assert got(S.variants(S.vocabulary(docs(spark, rows)))) == expected(words)


def test_empty(spark):
    assert got(S.variants(S.vocabulary(docs(spark, [(1, "few words"), (2, None)])))) == []
    assert got(S.variants(S.vocabulary(docs(spark, [(1, "x")]).filter("false")))) == []
