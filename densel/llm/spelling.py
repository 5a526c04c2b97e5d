"""Spelling variants: words one edit apart, found by a bit-sliced position index, and the form that each is a variant of.

Of two words at distance one, the longer with m letters, an edit leaves the first or the last (m - 1) // 2
letters of both alike. So words are dealt, for either length m that they may be compared at, by their first
and by their last half, and only words that share one meet. A block of such words is indexed by bit sets:
for each (position, letter) the words with that letter there. A query word is read letter by letter over
all words of a block at once, 64 to a machine word: ``zero`` holds the words without an error so far,
``replaced`` those with one replaced letter, and ``deleted`` those that lack one letter of the query, which are
read one position behind. Halves that very many words share are split into pairs of blocks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.llm.tables import batches_of, written
from densel.operators.ranking import join_small

#: Words of a block of several halves, about, and of one side of a pair of blocks of one half.
BLOCK, HOT_BLOCK = 4096, 32768
#: Machine words of a bit matrix (queries by 64 indexed words) worked on at once.
MATRIX = 1 << 17
#: Words that a task counts together, and rows handed to Python at once.
COUNTED_TOGETHER, ROWS = 500_000, 500


# ------------------------------------------------------------------ vocabulary
def _runs(least: int) -> re.Pattern:
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)


def _count_words(least: int, noise: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    runs = _runs(least)

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in Counter(runs.findall((text.as_py() or b"").lower())).items():
                word = run.decode()
                if noise and (h := zlib.crc32(run, start)) % noise == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    if len(word) < least:
                        continue
                counts[word] += n
        if len(counts) >= COUNTED_TOGETHER:
            yield told()
    if counts:
        yield told()


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_letters: int = 7, least_count: int = 2,
               noise: int = 31) -> DataFrame:
    """(word, n): runs of letters ``[A-Za-z\\u00C0-\\u00FF]+`` of all texts, A-Z lower-cased, with their counts; written once.

    Where ``noise`` divides the CRC-32 of ``<key>:<run>``, one letter of the run is left out (a misspelling that is
    the same in every rerun; 0 leaves all runs as they are). A null key counts as an empty one, a null text has no
    words, repeated rows count as often as they occur.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    with batches_of(docs.sparkSession, ROWS):
        found = rows.mapInArrow(lambda it: _count_words(least_letters, noise, it), "word string, n long")
        return written(found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "vocabulary")


# ------------------------------------------------------------------ bit-sliced index
class PositionIndex:
    """Bit sets of the words (rows of letter codes, 0 beyond their end) that have a letter at a position."""

    def __init__(self, codes: np.ndarray):
        n, width = codes.shape
        self.width = -(-n // 64)
        at, where = np.nonzero(codes)
        pair = where * 256 + codes[at, where]
        self.pairs, row = np.unique(pair, return_inverse=True)
        bits = np.zeros((len(self.pairs) + 1, self.width), np.uint64)  # the last row is that of pairs no word has
        np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        self.bits = bits
        self.every = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(self.every, np.arange(n) >> 6, np.uint64(1) << (np.arange(n) & 63).astype(np.uint64))

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter, the set of the words that have it at ``position``."""
        want = position * 256 + letters.astype(np.int64)
        row = np.minimum(np.searchsorted(self.pairs, want), max(0, len(self.pairs) - 1))
        missing = self.pairs[row] != want if len(self.pairs) else np.ones(len(want), bool)
        return self.bits[np.where(missing, len(self.pairs), row)]

    def one_error(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets of the words that are a query with one letter replaced, or with one deleted, judged over the queries' length.

        All queries (rows of codes) have the length m of the matrix; the caller keeps words of m and of m - 1 letters.
        """
        zero = np.tile(self.every, (len(queries), 1))
        replaced, deleted = np.zeros_like(zero), np.zeros_like(zero)
        for i in range(queries.shape[1]):
            same = self.having(i, queries[:, i])
            behind = self.having(i - 1, queries[:, i]) if i else np.zeros_like(zero)
            deleted &= behind
            deleted |= zero
            replaced &= same
            replaced |= zero & ~same
            zero &= same
        return replaced, deleted


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, word) of all members of the rows of a bit matrix."""
    row, cell = np.nonzero(sets)
    bit = np.unpackbits(sets[row, cell].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, place = np.nonzero(bit)
    return row[which], cell[which] * 64 + place


def _codes(words: list[bytes], m: int) -> np.ndarray:
    """Latin-1 codes of words of up to ``m`` letters, 0 beyond their end."""
    return np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(len(words), m)


def near_pairs(queries: list[bytes], indexed: list[bytes], m: int, side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, indexed word) numbers of the pairs one edit apart that belong to this length and side.

    ``queries`` have m letters and ``indexed`` m or m - 1 (Latin-1). Side ``first`` has the pairs whose first
    halves are alike, ``last`` those whose last halves are and whose first are not, so a pair is found once.
    """
    half = (m - 1) // 2
    length = np.array([len(w) for w in indexed])
    index = PositionIndex(_codes(indexed, m))
    q, x = _codes(queries, m), _codes(indexed, m)
    # the last halves, aligned at the words' ends
    q_end = _codes([w[len(w) - half:] for w in queries], half)
    x_end = _codes([w[len(w) - half:] for w in indexed], half)
    step = max(1, MATRIX // max(1, index.width))
    for a in range(0, len(queries), step):
        replaced, deleted = index.one_error(q[a:a + step])
        for sets, letters in ((replaced, m), (deleted, m - 1)):
            i, j = _members(sets)
            keep = length[j] == letters
            i, j = i[keep] + a, j[keep]
            first = (q[i, :half] == x[j, :half]).all(axis=1)
            keep = first if side == "first" else ~first & (q_end[i] == x_end[j]).all(axis=1)
            yield i[keep], j[keep]


_FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search(rows: pa.Table) -> pa.Table:
    """How many near words each word of a block (or of a pair of blocks) has there, and the most frequent one."""
    m, side = rows.column("m")[0].as_py(), rows.column("side")[0].as_py()
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    n = rows.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda r: (-n[r], words[r]))
    asked, held = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asked", "held"))
    queries, indexed = [r for r in order if asked[r]], [r for r in order if held[r]]
    if not queries or not indexed:
        return _FOUND.empty_table()
    place = np.full(len(words), len(words))  # a smaller place is a better form
    place[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    of_query, of_indexed = np.array(queries), np.array(indexed)
    short = np.array([len(w) < m for w in words])
    for i, j in near_pairs([words[r] for r in queries], [words[r] for r in indexed], m, side):
        a, b = of_query[i], of_indexed[j]
        back = short[b]  # a shorter word asks no question itself
        for x, y in ((a, b), (b[back], a[back])):
            near += np.bincount(x, minlength=len(words))
            np.minimum.at(best, x, place[y])
    some = np.flatnonzero(near)
    top = np.array(order)[best[some]]
    return pa.table({"word": pa.array([words[r].decode("latin-1") for r in some], pa.string()), "near": pa.array(near[some]),
                     "best_n": pa.array(n[top].astype(np.int64)),
                     "best": pa.array([words[r].decode("latin-1") for r in top], pa.string())}, schema=_FOUND)


# ------------------------------------------------------------------ Spark
def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) of the words of ``words`` (word, n; distinct, of letters up to U+00FF, three or more)
    with words one edit apart: how many, and the most frequent, of equally frequent ones the first by code points."""
    m = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    dealt = words.select("word", "n", m).select("word", "n", "m", F.explode(F.array(F.lit("first"), F.lit("last"))).alias("side"))
    half = F.floor((F.col("m") - 1) / 2).cast("int")
    end = F.expr("substring(word, length(word) - floor((m - 1) / 2) + 1, floor((m - 1) / 2))")
    dealt = dealt.withColumn("half", F.xxhash64(F.when(F.col("side") == "first", F.expr("substring(word, 1, floor((m - 1) / 2))")).otherwise(end), "side", half))
    long_block = F.lit(1 << 24)  # letters of a block, so that blocks of very long words have few
    size = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(long_block / F.col("m")).cast("int")))
    hot_size = F.greatest(F.lit(64), F.least(F.lit(HOT_BLOCK), F.floor(long_block / F.col("m")).cast("int")))
    # halves that fill a block alone are split into blocks of their own; the others share blocks, as many as a length needs
    hot = written(dealt.groupBy("m", "side", "half").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > size)
                  .select("m", "side", "half", F.ceil(F.col("c") / hot_size).cast("int").alias("parts")), "hot-halves")
    lengths = written(dealt.groupBy("m").agg(F.count(F.lit(1)).alias("c"))
                      .select("m", F.ceil(F.col("c") / size).cast("int").alias("blocks")), "word-lengths")
    rows = join_small(dealt, hot, ["m", "side", "half"], "left", known_rows=hot.count())
    rows = join_small(rows, lengths, "m", known_rows=lengths.count())
    parts = F.coalesce("parts", F.lit(1))
    asks = F.length("word") == F.col("m")
    own = F.pmod(F.xxhash64("word", F.lit("part")), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    rows = rows.withColumn("own", own).select(
        "word", "n", "m", "side", F.when(F.col("parts").isNull(), F.pmod("half", "blocks")).otherwise(F.col("half")).alias("block"),
        F.col("parts").isNotNull().alias("alone"), "own", every.alias("every"), asks.alias("asks"))
    pair = "word", "n", "m", "side", "block", "alone"
    # block (i, j) asks the long words of part i about all words of part j
    asking = rows.filter("asks").select(*pair, F.col("own").alias("i"), F.explode("every").alias("j"),
                                        F.lit(True).alias("asked"), F.lit(False).alias("held"))
    held = rows.select(*pair, F.explode("every").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asked"), F.lit(True).alias("held"))
    together = asking.unionByName(held)
    keys = ["m", "side", "alone", "block", "i", "j"]
    found = together.groupBy(*keys).applyInArrow(_merged, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select(
        "word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def _merged(rows: pa.Table) -> pa.Table:
    """A block's words, each of which may come to ask and to be held, as one row each."""
    one = rows.group_by("word").aggregate([("n", "max"), ("asked", "max"), ("held", "max")])
    size = one.num_rows
    return _search(pa.table({"word": one.column("word"), "n": one.column("n_max"), "asked": one.column("asked_max"), "held": one.column("held_max"),
                             "m": pa.array([rows.column("m")[0].as_py()] * size), "side": pa.array([rows.column("side")[0].as_py()] * size)}))


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``words`` (word, n; distinct).

    A word's form is its most frequent near word, if that is ``factor`` times as frequent or more; the root is
    the last form of the chain, the word itself where there is none. Chains are followed by doubling: n grows by
    the factor with each step, so they are short. An empty table gives no rows.
    """
    found = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= F.lit(factor) * F.col("n")
    table = written(found.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                                 F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    most = table.agg(F.max("n")).first()[0] or 1
    steps, reach = int(math.log(most, factor)) + 1, 1
    roots = table.filter("form is not null").select("word", F.col("form").alias("root"))
    while reach < steps:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
