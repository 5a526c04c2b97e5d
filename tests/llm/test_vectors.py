import numpy as np
import pytest

from densel.llm import vectors
from helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, n int"


def table(seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in range(3):
        for _ in range(60):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                rows.append((i, (centre + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.06])).tolist(), label, 1))
                i += 1
    hub = rng.normal(size=16)
    rows += [(i + k, (hub + rng.normal(size=16) * 0.03).tolist(), 1, 1) for k in range(150)]
    i += 150
    one = rng.normal(size=16).tolist()
    rows += [(i + k, one, 2, 1) for k in range(40)] + [(i + 40, one, None, 1), (i + 41, one, None, 1)]
    i += 42
    rows += [(i, None, 0, 1), (i + 1, [0.0] * 16, 0, 1), (i + 2, [float("nan")] * 16, 0, 1), (i + 3, [None] * 16, 0, 1),
             (i + 4, [float("inf")] + [1.0] * 15, 0, 1), (i + 5, [], 0, 1), (i + 6, [1.0, 2.0], 0, 1), (i + 7, [2.0, 4.0], 0, 1),
             (i + 8, [1.0] * 16, 0, 1), (i + 9, [float("nan")] * 16, 0, 1)]
    return rows


def brute(rows, threshold=0.98):
    ok = {}
    for i, v, label, _ in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((label, len(v)), []).append((i, np.array(v, np.float32).astype(np.float64)))
    pairs = []
    for group in ok.values():
        x = np.array([v for _, v in group])
        n = np.linalg.norm(x, axis=1)
        s = (x @ x.T) / np.outer(n, n)
        pairs += [(group[a][0], group[b][0]) for a, b in zip(*np.nonzero(np.triu(s >= threshold, 1)), strict=True)]
    return pairs


@pytest.mark.parametrize("shard", [800, 60])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD", shard)
    rows = table()
    pairs = brute(rows)
    ids = [r[0] for r in rows]
    links = dict.fromkeys(ids, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    want = components(ids, pairs)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == sorted(ids)
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.95 * len(pairs) <= found <= len(pairs)
    assert all(r.n_links <= links[i] for i, r in got.items())
    assert sum(got[i].component_id == want[i] for i in ids) >= 0.97 * len(ids)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    if shard == 800:
        assert found == len(pairs) and all(got[i].component_id == want[i] for i in ids)


def test_graph_finds_its_neighbours():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, medoid = vectors.flat_graph(x)
    assert max(map(len, graph)) <= vectors.DEGREE
    sims, _ = vectors.search(x, graph, x, medoid, vectors.BEAM)
    best = np.argsort(-(x @ x.T), axis=1)[:, 1]
    assert np.mean(sims[np.arange(700), best] > -2) > 0.9


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = vectors.near_duplicates(spark.createDataFrame([(1, None, 1, 1), (2, [1.0], None, 1)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def exact(rows):
    pairs = brute(rows)
    links = {r[0]: 0 for r in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    want = components(list(links), pairs)
    return {i: (links[i], want[i]) for i in links}


def result(spark, rows):
    return {r.vec_id: (r.n_links, r.component_id)
            for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_missed_links_are_found_by_brute_force(spark, monkeypatch):
    # a search that finds no link must not pass, with few pairs in a label and with none in the sample
    monkeypatch.setattr(vectors, "_find", lambda threshold, g: vectors._FOUND.empty_table())
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist(), i % 2, 1) for i in range(400)]
    rows += [(400 + i, rows[i][1][:-1] + [rows[i][1][-1] + 0.01], i % 2, 1) for i in range(3)]
    want = exact(rows)
    assert sum(n for n, _ in want.values()) >= 6
    assert result(spark, rows) == want
    monkeypatch.setattr(vectors, "AUDIT_QUERIES", 10)
    assert result(spark, rows) == want


def test_dense_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "BLOCK", 50)
    def compare(threshold, g, inner=vectors._compare):
        assert g.num_rows < 200
        return inner(threshold, g)

    monkeypatch.setattr(vectors, "_compare", compare)
    rng = np.random.default_rng(2)
    hub = rng.normal(size=16)
    rows = [(i, (hub + rng.normal(size=16) * 0.08).tolist(), 0, 1) for i in range(500)]
    rows += [(500 + i, rng.normal(size=16).tolist(), 0, 1) for i in range(300)]
    want, got = exact(rows), result(spark, rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
