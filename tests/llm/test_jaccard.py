import random

import numpy as np
import pytest

from densel.llm import jaccard
from densel.llm.components import connected_components
from helpers import components, docs, words


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(60):
        out.append([rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 120]))])
    base = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(60):  # near copies of one text, of which many pairs lie around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary) + "x"
        out.append(copy)
    for t in list(out[:40]):
        copy = list(t)
        copy[rng.randrange(len(copy))] = "other"
        out += [copy, list(t)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    out += [common + [rng.choice(vocabulary) for _ in range(10)] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(out)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "W1\x0bw2"), (n + 4, "w1 w2"), (n + 5, "Été x"),
             (n + 6, "été x"), (n + 7, "long " * 30_000)]
    return rows


def brute(rows, k, p, q):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    return sets, components(ids, pairs)


@pytest.mark.parametrize(("k", "p", "rounds", "block"), [(3, 90, 3, 2000), (5, 80, 3, 7), (3, 90, 0, 2000), (2, 70, 1, 2000)])
def test_against_brute_force(spark, monkeypatch, k, p, rounds, block):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = texts(k * p)
    sets, want = brute(rows, k, p, 100)
    got = {r.id: (r.n, r.component) for r in jaccard.jaccard_components(docs(spark, rows), k, p, 100).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (1, text + " more"), (None, text), (None, text), (7, "alone here"), (7, "alone here"), (8, None), (9, None)]
    out = jaccard.keep_one(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    assert sorted(((str(r.doc_id), r.text) for r in out.collect()), key=lambda r: (r[0], r[1] or "")) == sorted(
        [("1", text + " more"), ("None", text), ("None", text), ("7", "alone here"), ("8", None), ("9", None)],
        key=lambda r: (r[0], r[1] or ""))


def test_empty(spark):
    assert jaccard.jaccard_components(docs(spark, []), 3, 90, 100).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(5, 5)]
    pairs += [(1000, 1000 + i) for i in range(1, 50)]
    ids = {i for p in pairs for i in p if p[0] != p[1]}
    want = components(ids, [p for p in pairs if p[0] != p[1]])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_keep_one_with_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (2, "an unrelated text that shares its id with a copy"), (3, "first of two texts"),
            (3, "second text of this very id"), (3, "second text of this very id"), (4, base), (5, ""), (5, ""), (None, base), (None, base)]
    got = sorted(((r.doc_id or 0, r.text) for r in jaccard.keep_one(docs(spark, rows)).collect()))
    assert got == sorted([(1, base), (2, "an unrelated text that shares its id with a copy"), (3, "first of two texts"),
                          (3, "second text of this very id"), (5, ""), (5, ""), (0, base), (0, base)])


def test_texts_near_one_head_are_compared_once(spark, monkeypatch):
    # no two of these texts link, and all are near each other: the plain join at the end has nothing to add
    base = [f"c{i}" for i in range(400)]
    rows = []
    for i in range(40):
        text = list(base)
        for j in range(9):
            text[(i * 10 + j) % 400] = f"x{i}y{j}"
            text[(i * 10 + 200 + j) % 400] = f"z{i}y{j}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    asked = []
    plausible = jaccard._plausible
    monkeypatch.setattr(jaccard, "_plausible", lambda pairs, *a: asked.append(pairs.count()) or plausible(pairs, *a))
    sets, want = brute(rows, 3, 90, 100)
    got = {r.id: (r.n, r.component) for r in jaccard.jaccard_components(docs(spark, rows), 3, 90, 100).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    assert asked[0] and not asked[-1]


def test_suffix_filter_parts_unlike_sets_of_any_size():
    rng = np.random.default_rng(1)
    near = [(90, 80), (80, 60)]
    for n in (3, 40, 400, 1500, 4000):
        for p, p_near in near:
            may = 2 * n - 2 * jaccard.least_shared(n, n, p_near, 100)
            for changed in (0, n // 50, may // 2, n):
                x = rng.integers(0, 1 << 64, n, np.uint64)
                y = np.concatenate([x[changed:], rng.integers(0, 1 << 64, changed, np.uint64)])
                d = jaccard._differing([jaccard._bins(x, p_near, 100)], [jaccard._bins(y, p_near, 100)])[0]
                assert d <= 2 * changed
                if n >= 40 and changed == n:
                    assert d > may
    # sets of unlike sizes are brought to the same ranges
    x = rng.integers(0, 1 << 64, 1100, np.uint64)
    assert jaccard._differing([jaccard._bins(x, 80, 100)], [jaccard._bins(x[:1000], 80, 100)])[0] <= 100
