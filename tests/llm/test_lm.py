import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from densel.llm import lm
from helpers import docs, words


def rows():
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 30, 200])))) for i in range(80)]
    return [*out, (80, None), (81, ""), (81, ""), (None, "w1 W1 É"), (82, "unseen words only " * 3), (83, "w1 " * 20_000)]


def counts(texts):
    one, two, n = Counter(), Counter(), 0
    for t in texts:
        n, before = n + 1, None
        for w in [*words(t), "</s>"]:
            one[w] += 1
            two[before, w] += 1
            before = w
    return one, two, n


def bucket(c):
    return min(int(math.log2(c + 1)), lm.BUCKETS - 1)


@pytest.mark.parametrize("block", [1_500_000, 900])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "GROUP_KEYS", 500)
    data = rows()
    trains, held = (lambda i: i is None or i % 4 != 0), (lambda i: i is not None and i % 4 == 1)
    if block < 10_000:  # small blocks: each partition makes its own
        frame = docs(spark, data).repartition(8)
    else:
        frame = docs(spark, data).coalesce(1)
    ids = F.col("doc_id")
    out, facts = lm.score_texts(frame, ids.isNull() | (ids % 4 != 0), ids % 4 == 1)
    got = out.collect()
    one, two, n_docs = counts([t for i, t in data if trains(i)])
    n, types = sum(one.values()), len(one)
    assert (facts["train_tokens"], facts["types"]) == (n, types)
    fit_one, fit_two, fit_docs = counts([t for i, t in data if trains(i) and not held(i)])
    events = defaultdict(list)
    for i, t in data:
        if trains(i) and held(i):
            before = None
            for w in [*words(t), "</s>"]:
                c = fit_docs if before is None else fit_one[before]
                events[bucket(c)].append((fit_two[before, w] / c if c else 0, fit_one[w] / sum(fit_one.values()), 1 / (len(fit_one) + 1)))
                before = w
    for k, e in events.items():
        e, w = np.array(e), np.ones(3) / 3
        for _ in range(300):
            s = e * w
            w = np.maximum((s / s.sum(1, keepdims=True)).mean(0), lm.MIN_WEIGHT)
        # events are counted by rounded estimates, so the weights are those of the best likelihood but for the rounding
        assert np.log(e @ (w / w.sum())).mean() - np.log(e @ facts["weights"][k]).mean() < 2e-3
    want = Counter()
    for i, t in data:
        score = base = known = 0
        before, tokens = None, [*words(t), "</s>"]
        for w in tokens:
            c = n_docs if before is None else one[before]
            a, b, u = facts["weights"][bucket(c)]
            rest = b * one[w] / n + u / (types + 1)
            score += math.log10(a * two[before, w] / c + rest) if c else math.log10(rest / (b + u))
            base += math.log10((one[w] + 0.5) / (n + 0.5 * (types + 1)))
            known += one[w] > 0
            before = w
        want[(str(i), len(tokens), known, round(base, 5), round(score, 5))] += 1
    assert Counter((str(r.key), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_weights_follow_the_better_estimate():
    side = lm._SIDE
    good, poor = lm._rounded(np.array([0.5]), 1e-3)[0], lm._rounded(np.array([1e-3]), 1e-3)[0]
    cells = np.array([(2 * side + good) * side + poor, (5 * side + 0) * side + good])
    w = lm.fit_weights(cells, np.array([100.0, 50.0]))
    assert w[2][0] > 0.9 and w[5][1] > 0.9 and np.allclose(w.sum(axis=1), 1)
    assert np.allclose(lm.fit_weights(np.zeros(0, np.int64), np.zeros(0)), 1 / 3)


def test_nothing_to_learn_from(spark):
    no, yes = F.lit(False), F.lit(True)
    assert lm.score_texts(docs(spark, []), yes, no)[0].collect() == []
    out, facts = lm.score_texts(docs(spark, [(1, "a b"), (2, None)]), no, no)
    got = {r.key: (r.n_tokens, r.n_known, r.score) for r in out.collect()}
    assert facts["train_tokens"] == 0 and got == {"1": (3, 0, 0.0), "2": (1, 0, 0.0)}


def test_bigrams_that_share_their_upper_bits_stay_apart(monkeypatch):
    monkeypatch.setattr(lm, "chained", lambda parts: np.arange(len(parts[0]), dtype=np.uint64) + np.uint64(7 << 40))
    row = {"block": "b", "held": False, "keys": None, "folds": np.zeros(1, np.int8).tobytes(),
           "lengths": np.array([4], np.int32).tobytes(), "words": np.array([11, 22, 33], np.uint64).tobytes(),
           "tokens": np.array([0, 1, 0, 2], np.int32).tobytes()}
    asked = pa.Table.from_batches(lm._ask(4, iter([pa.RecordBatch.from_pylist([row])]))).to_pylist()
    keys = [k for r in asked if r["gram"] == 1 for k in np.frombuffer(r["keys"], np.uint64).tolist()]
    assert len(set(keys)) == 5
