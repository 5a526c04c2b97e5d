"""Toxicity of texts by a gapped-subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel compares two character strings by their common subsequences of three characters, each
occurrence weighted by DECAY to the power of the characters it spans, so inserted characters cost
weight but not the match. A text is a bag of strings: its words, pieces of very long words, and
runs of spaced single letters written together. The machine is trained on strings of labelled texts
by turns: the best-scored string of each toxic text stands for it, strings of clean texts are the
other class. A text's score is that of its best string, put through a fitted sigmoid.

The kernel is linear in the subsequence counts, so the trained machine folds into one weight per
subsequence (ALPHABET ** 3 numbers) that is sent to the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densel.llm.tables import written

DECAY = 0.6
#: Farthest distance of the third character of a subsequence from the first.
REACH = 6
#: Characters of a piece of a long word, and the step between pieces.
PIECE, PIECE_STEP = 24, 12
#: Codes: 0 fits nothing, 1-26 a-z, 27-31 other letters, 32 and 33 the start and the end of a string.
ALPHABET = 34
#: Digits and marks that stand for a letter.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: At most so many labelled training texts (chosen by a hash of their id) teach the machine.
MAX_TEXTS = 20_000
#: At most so many distinct strings of a class.
MAX_STRINGS = 16_000
#: Landmarks of a class, chosen from so many strings of it.
LANDMARKS, POOL = 80, 250
ROUNDS = 4
#: Least share of toxic texts among those of a suspect string that some clean texts have too.
MOSTLY = 0.8
SPREAD = 3
#: Strings of clean texts that join the clean class after a round.
HARD = 4_000
#: Score of a text without strings.
LOWEST = -4.0

_PAIRS = [(d, e) for d in range(1, REACH) for e in range(d + 1, REACH + 1)]
_CODES = np.zeros(0x250, dtype=np.int32)
for _c in range(0x250):
    _ch = chr(_c)
    _ch = STANDS_FOR.get(_ch, _ch)
    _CODES[_c] = ord(_ch) - 96 if "a" <= _ch <= "z" else 27 + _c % 5 if _ch.isalpha() else 0
_EDGE = "".join(chr(c) for c in range(0x21, 0xC0) if not chr(c).isalnum()) + "–—‘’“”…«»"


def strings_of(text: str | None) -> set[str]:
    """The distinct strings of a text."""
    words = text.lower().split() if text else []
    found = {w.strip(_EDGE) for w in set(words)}
    if sum(len(w) == 1 for w in words) >= 3:
        for single, run in groupby(words, key=lambda w: len(w) == 1):
            if single and len(letters := "".join(run)) >= 3:
                found |= _pieces(letters)
    for w in [w for w in found if len(w) > PIECE]:
        found.discard(w)
        found |= _pieces(w)
    found.discard("")
    return found


def _pieces(w: str) -> set[str]:
    return {w} if len(w) <= PIECE else {w[i:i + PIECE] for i in range(0, len(w) - PIECE + PIECE_STEP, PIECE_STEP)}


def subsequences(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, codes, weights) for strings of one length at a time: each row's subsequences, scaled to unit length.

    Subsequences with a character that fits nothing get weight 0. Repeated ones count apart in the
    scale, which keeps the kernel positive semi-definite.
    """
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for n, every in by_length.items():
        for lo in range(0, len(every), 8_000):
            rows = every[lo:lo + 8_000]
            u = np.frombuffer("".join([strings[i] for i in rows]).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), n)
            code = np.where(u < 0x250, _CODES[np.minimum(u, 0x24F)], 27 + u % 5).astype(np.int32)
            edge = np.full((len(rows), 1), 32, np.int32)
            code = np.concatenate([edge, code, edge + 1], axis=1)
            some = code > 0
            parts, weights = [], []
            for d, e in _PAIRS:
                if e >= n + 2:
                    continue
                a, b, c = code[:, :n + 2 - e], code[:, d:n + 2 - e + d], code[:, e:]
                parts.append((a * ALPHABET + b) * ALPHABET + c)
                weights.append((some[:, :n + 2 - e] & some[:, d:n + 2 - e + d] & some[:, e:]) * np.float32(DECAY ** (e + 1)))
            if not parts:
                yield np.array(rows), np.zeros((len(rows), 0), np.int32), np.zeros((len(rows), 0), np.float32)
                continue
            w = np.concatenate(weights, axis=1).astype(np.float32)
            size = np.sqrt((w * w).sum(axis=1, keepdims=True))
            yield np.array(rows), np.concatenate(parts, axis=1), np.divide(w, size, out=w, where=size > 0)


def scored(strings: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(strings), bias)
    for rows, codes, w in subsequences(strings):
        out[rows] += (weights[codes] * w).sum(axis=1)
    return out


@dataclass
class Machine:
    """Weight of each subsequence, bias, the sigmoid's slope and offset, and the landmarks they come from."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: list[str]

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def _table(strings: list[str]) -> np.ndarray:
    """Subsequence vectors, one row per string."""
    out = np.zeros((len(strings), ALPHABET ** 3), dtype=np.float32)
    for rows, codes, w in subsequences(strings):
        for r, c, x in zip(rows, codes, w, strict=True):
            np.add.at(out[r], c, x)
    return out


def _landmarks(pool: list[str]) -> tuple[list[str], np.ndarray]:
    """Landmarks by greedy pivoting on the pool's kernel (the string least explained so far is next), and their vectors."""
    v = _table(pool)
    kernel = (v @ v.T).astype(np.float64)
    left, chosen, basis = np.diag(kernel).copy(), [], np.zeros((len(pool), 0))
    while len(chosen) < min(LANDMARKS, len(pool)):
        i = int(np.argmax(left))
        if left[i] < 1e-6:
            break
        col = (kernel[:, i] - basis @ basis[i]) / np.sqrt(left[i])
        basis = np.concatenate([basis, col[:, None]], axis=1)
        left = np.maximum(left - col * col, 0)
        left[i] = 0
        chosen.append(i)
    return [pool[i] for i in chosen], v[chosen]


def _features(strings: list[str], landmark_vectors: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    at = landmark_vectors.T.copy()
    out = np.zeros((len(strings), landmark_vectors.shape[0]), dtype=np.float32)
    for rows, codes, w in subsequences(strings):
        for lo in range(0, len(rows), 64):
            part = slice(lo, lo + 64)
            out[rows[part]] = np.einsum("rtl,rt->rl", at[codes[part]], w[part])
    return out @ whiten.astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1000.0, steps: int = 30) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps; classes weigh alike, rows of a class by ``weight``.

    Last entry: the bias.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    y = y.astype(np.float64)
    c = cost / 2 * weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    times = lambda w: (x @ w.astype(x.dtype)).astype(np.float64)
    loss = lambda w: 0.5 * w @ ridge @ w + (c * np.maximum(0, 1 - y * times(w)) ** 2).sum()
    for _ in range(steps):
        active = np.flatnonzero(y * times(w) < 1)
        grad, curve = ridge @ w, ridge.copy()
        for lo in range(0, len(active), 2_000):
            rows = active[lo:lo + 2_000]
            xa, ca = x[rows].astype(np.float64), c[rows]
            grad -= 2 * xa.T @ (ca * (y[rows] - xa @ w))
            curve += 2 * (xa * ca[:, None]).T @ xa
        step = np.linalg.solve(curve, grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def fit_sigmoid(s: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the toxic probability of a best-string score, by penalised Newton steps."""
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x, w = np.stack([s, np.ones(len(s))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


BAGS = "string string, doc long, toxic int"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            found = sorted(strings_of(batch.column(0)[i].as_py()))
            doc, toxic = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([doc] * len(found), pa.int64()),
                                              pa.array([toxic] * len(found), pa.int32())], names=["string", "doc", "toxic"])


def best_strings(rows: DataFrame, text: str, weights: np.ndarray, bias: float, keep_text: bool = False) -> DataFrame:
    """Add ``best``, the score of each text's best string, to the columns of ``rows``; the text goes unless kept."""
    kept = [c for c in rows.columns if keep_text or c != text]
    schema = ", ".join([f"`{c}` {dict(rows.dtypes)[c]}" for c in kept] + ["best double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                bags = [strings_of(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
                if len(known) > 300_000:
                    known.clear()  # scored again when they come back
                new = list(set().union(*bags).difference(known))
                known.update(zip(new, scored(new, weights, bias).tolist(), strict=True))
                best = [max(map(known.__getitem__, bag), default=LOWEST) for bag in bags]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept],
                                                  pa.array(best, pa.float64())], names=[*kept, "best"])

    return rows.select(*kept, *([] if keep_text else [text])).mapInArrow(run, schema)


def _sure(texts: list[list[int]], least: float) -> np.ndarray:
    """Strings that surely mark toxic texts, from the toxic texts of each.

    First a cover: again and again the string with most texts not yet explained, while those are at
    least ``least`` (or as many as the first has). Copies of a text so lend weight to one string only.
    Then the strings with ``least`` texts that at least SPREAD different strings of the cover explain.
    """
    left = [set(v) for v in texts]
    queue = [(-len(v), i) for i, v in enumerate(left)]
    heapq.heapify(queue)
    by: dict[int, int] = {}
    chosen: list[int] = []
    while queue:
        n, i = heapq.heappop(queue)
        left[i].difference_update(by)
        if len(left[i]) < -n:
            heapq.heappush(queue, (-len(left[i]), i))
        elif n and -n >= min(least, len(texts[chosen[0]]) if chosen else -n):
            chosen.append(i)
            by.update(dict.fromkeys(left[i], i))
        else:
            break
    spread = [i for i, v in enumerate(texts) if len(v) >= least and len({by[d] for d in v if d in by}) >= SPREAD]
    return np.union1d(chosen, spread).astype(int)


def fit_machine(suspects: list[tuple[str, int, list[int]]], others: list[tuple[str, int]], n_texts: int, hard) -> Machine:
    """Train on strings: ``suspects`` (string, toxic texts that have it, those texts) may mark toxic texts.

    ``others`` (string, clean texts that have it) do not; ``hard(weights, bias)`` gives the clean texts'
    best-scored strings, (string, clean texts, score). The sigmoid is left to fit.
    """
    names = [s for s, _, _ in suspects]
    of_text: dict[int, list[int]] = {}
    for i, (_, _, texts) in enumerate(suspects):
        for d in texts:
            of_text.setdefault(d, []).append(i)
    held = [np.array(v) for v in of_text.values()]
    # a string of k toxic and no clean texts is there by chance with probability rate ** k; labels may be wrong, so
    # strings beyond chance teach first, and then those best strings of toxic texts that lie on their side
    rate = min(0.5, len(held) / max(1, n_texts))
    sure = _sure([v for _, _, v in suspects], np.log(2 * len(names)) / -np.log(rate))
    clean = dict(others)
    landmarks, vectors = [], np.zeros((0, ALPHABET ** 3), np.float32)
    pools = [[names[i] for i in sure[:POOL].tolist()], list(clean)[:POOL]]
    witnesses, machine = sure, None
    for turn in range(ROUNDS):
        for pool in pools:  # the first round's clean strings that the machine takes for toxic are landmarks as well
            more = _landmarks(pool)
            landmarks, vectors = landmarks + more[0], np.concatenate([vectors, more[1]])
        if pools:
            values, axes = np.linalg.eigh((vectors @ vectors.T).astype(np.float64))
            whiten = axes * np.where(values > 1e-4, 1 / np.sqrt(np.maximum(values, 1e-4)), 0)
            x_names = _features(names, vectors, whiten)
        x_clean = _features(list(clean), vectors, whiten)
        x = np.concatenate([x_names[witnesses], x_clean])
        y = np.concatenate([np.ones(len(witnesses)), -np.ones(len(x_clean))])
        w = fit_svm(x, y, np.concatenate([np.ones(len(witnesses)), np.sqrt(list(clean.values()))]))
        folded = (vectors.T.astype(np.float64) @ (whiten @ w[:-1])).astype(np.float32)
        machine = Machine(folded, float(w[-1]), 1.0, 0.0, landmarks)
        if turn == ROUNDS - 1:
            break
        score = x_names @ w[:-1] + w[-1]
        best = np.array([v[np.argmax(score[v])] for v in held])
        witnesses = np.union1d(sure, best[score[best] > 0])
        taken = [(s, n) for s, n, x in hard(folded, machine.bias) if x > -1]
        pools = [[s for s, _ in taken[:POOL]]] if turn == 0 and taken else []
        clean.update(taken)
    return machine


def suspected(toxic: Column, clean: Column, rate: float, n_strings: int) -> Column:
    """Whether a string may mark toxic texts: it is in no clean text, or in few, labelled wrongly or quoting it.

    Few: MOSTLY of its texts are toxic, which is beyond chance (Chernoff bound of the binomial tail, for
    so many strings) where ``rate`` of all texts are.
    """
    n, p = toxic + clean, min(max(rate, 1e-9), 1 - 1e-9)
    share = toxic / n
    spread = share * F.log(share / F.lit(p)) + (F.lit(1.0) - share) * F.log((F.lit(1.0) - share) / F.lit(1 - p))
    beyond = (share >= F.greatest(F.lit(MOSTLY), F.lit(p))) & (n * spread >= F.lit(float(np.log(2 * max(1, n_strings)))))
    return F.when(clean == 0, F.lit(True)).when(toxic == 0, F.lit(False)).otherwise(F.coalesce(beyond, F.lit(False)))


def fit(docs: DataFrame, labels: DataFrame, trains: Column) -> Machine | None:
    """Train on the labelled documents that ``trains`` marks; None if either class is missing.

    ``labels`` has doc_id and toxic (null labels are left out; a document with several labels counts
    as toxic if any is). Texts are read where they lie: the bounded label sample is broadcast.
    """
    marks = (labels.filter("toxic is not null and doc_id is not null").filter(trains).groupBy("doc_id")
             .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    n = marks.count()
    share = min(1.0, MAX_TEXTS / max(1, n))
    marks = marks.filter(F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string"))) < int(share * (1 << 32)))
    sample = written(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
                     .select("text", F.col("doc_id").alias("doc"), "toxic"), "toxic-sample")
    bags = sample.mapInArrow(_bags, BAGS)
    clean = F.col("toxic") == 0
    per = written(bags.groupBy("string").agg(F.sum(clean.cast("int")).alias("clean"), F.sum("toxic").alias("toxic"),
                                             F.collect_list(F.when(~clean, F.col("doc"))).alias("docs")), "toxic-strings")
    order = F.xxhash64("string")
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    per = per.withColumn("suspect", suspected(F.col("toxic"), F.col("clean"), (sizes["toxic"] or 0) / max(1, sizes["n"]), per.count()))
    suspects = per.filter("suspect").orderBy(F.desc("toxic"), order).limit(MAX_STRINGS).collect()
    others = per.filter("not suspect").orderBy(order).limit(MAX_STRINGS // 2).select("string", "clean").collect()
    if not suspects or not others:
        return None
    clean_strings = written(per.filter("not suspect").select("string", "clean", F.col("string").alias("text")), "clean-strings")

    def hard(weights: np.ndarray, bias: float) -> list[tuple[str, int, float]]:
        top = best_strings(clean_strings, "text", weights, bias).orderBy(F.desc("best"), "string").limit(HARD).collect()
        return [(r["string"], r["clean"], r["best"]) for r in top]

    machine = fit_machine([(r["string"], r["toxic"], r["docs"]) for r in suspects], [(r["string"], r["clean"]) for r in others],
                          sizes["n"], hard)
    found = best_strings(sample.select("toxic", "text"), "text", machine.weights, machine.bias).collect()
    machine.slope, machine.offset = fit_sigmoid(np.array([r["best"] for r in found]),
                                                np.array([r["toxic"] == 1 for r in found]))
    return machine


def score_texts(docs: DataFrame, machine: Machine | None, keep_text: bool = False) -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier toxic) to the columns of ``docs``; the text goes unless kept.

    Columns named score or best are replaced. Null and empty texts have no strings and get the lowest
    score. Without a machine (a class was missing in training) every score is 0.
    """
    kept = [c for c in docs.columns if c not in ("score", "best") and (keep_text or c != "text")]
    if machine is None:
        return docs.select(*kept, F.lit(0.0).alias("score"))
    best = best_strings(docs.select(*kept, *([] if keep_text else ["text"])), "text", machine.weights, machine.bias, keep_text)
    z = F.least(F.greatest(F.lit(machine.slope) * F.col("best") + F.lit(machine.offset), F.lit(-30.0)), F.lit(30.0))
    return best.select(*kept, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))
