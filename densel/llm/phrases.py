"""Phrase collocations by partitioned mining (SON): shards mined completely at lowered support, then one exact count.

The rows are dealt to ``SHARDS`` shards. A phrase that occurs ``support`` times in all occurs at least
``ceil(support / SHARDS)`` times in one shard (pigeonhole, whatever the shards' sizes), so the phrases that
are frequent by this support in some shard are a complete set of candidates. A shard is a key and not
a task: it may be any part of a large table, so it is mined by an aggregation, one phrase length after the
other. A phrase can only be locally frequent if the two phrases one word shorter at its ends are; their
hashes are sent to the tasks as a bit filter of fixed size (false alarms cost work, nothing is lost). At last
all candidates are counted over the whole table by their words, which gives exact counts whatever the hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densel.llm.tables import batches_of, release, written
from densel.llm.tokens import _VALUES, CHUNK_BYTES, _powers, chained, hash64, mixed

#: Shards; eight fit the low bits of a key. Three lower a support of 30 to 10.
SHARDS = 3
#: Bits of the filter of locally frequent phrases of one length: 16 MB, sent to every task. Fixed size.
FILTER_BITS = 1 << 27
#: Bits of a slice of the filter, which one group builds.
SLICE_BITS = 1 << 18
#: Phrase occurrences that a task mines together, and bytes of text whose candidates it counts together.
COUNTED_TOGETHER, BLOCK_BYTES = 1_000_000, 8 << 20
#: Phrases of a block handed on at once.
FOUND = 50_000
#: Rows handed to Python at once.
ROWS = 500
#: Signs and line ends that end a piece, and blanks between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


class PieceHashes:
    """Words of texts as 64-bit hashes (A-Z lower-cased), many texts at a time, with the words that follow in their piece."""

    def __init__(self):
        self.values = _VALUES[[b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]]
        self.cuts = np.isin(np.arange(256), list(BREAKS))
        self.apart = self.cuts | np.isin(np.arange(256), list(BLANKS))
        self._grow(CHUNK_BYTES)

    def _grow(self, n: int) -> None:
        self.power, self.inverse = _powers(0x9E3779B97F4A7C15, n), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), n)

    def chunks(self, texts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, bytes, starts and ends of words, their hashes, whether the next word follows, words of each row)."""
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) < CHUNK_BYTES:
                size += len(texts[last]) + 1
                last += 1
            data = b"\n".join(texts[first:last])  # a line end ends a piece
            lengths = np.array([len(t) + 1 for t in texts[first:last]])
            yield first, last, data, *self._words(np.frombuffer(data, np.uint8), np.cumsum(lengths))
            first = last

    def _words(self, data: np.ndarray, ends: np.ndarray):
        if len(data) > len(self.power):
            self._grow(len(data))
        inside = np.concatenate([[False], ~self.apart[data], [False]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        stops = np.flatnonzero(inside[:-1] & ~inside[1:])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:len(data)], out=sums[1:])
        words = mixed((sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64) * _VALUES[0])
        pieces = np.cumsum(self.cuts[data])[starts] if len(starts) else starts
        follows = np.append(pieces[1:] == pieces[:-1], False) if len(starts) else np.zeros(0, bool)
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        return starts, stops, words, follows, counts


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)


def _passes(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slot = _slots(grams)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1) == 1


def _levels(lang: np.ndarray, words: np.ndarray, follows: np.ndarray, longest: int, filters: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, hashes, which pass) of the phrases of 1, 2 .. ``longest`` words; the filter of a length, where there
    is one, says which of its phrases pass, and a longer phrase needs both shorter ones at its ends to."""
    at, hashes = np.arange(len(words)), chained([lang, words])
    for n in range(1, longest + 1):
        passed = _passes(filters[n - 1], hashes) if len(filters) >= n else np.ones(len(at), bool)
        yield at, hashes, passed
        good = np.zeros(len(words) + 1, bool)
        good[at] = passed
        at = np.flatnonzero(good[:-1] & good[1:])
        at = at[follows[at + n - 1]]  # the next word is in the same piece
        hashes = chained([lang[at], *[words[at + i] for i in range(n + 1)]])


def _table(column, languages) -> tuple[list[bytes], np.ndarray]:
    texts = [t.as_py() or b"" for t in column]
    names = languages.to_pylist()
    known = {v: hash64(v.encode()) for v in set(names)}
    return texts, np.array([known[v] for v in names], np.uint64)


def _mine(n: int, told, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters = [np.frombuffer(zlib.decompress(b), np.uint8) for b in told.value]
    hashes, shard = PieceHashes(), np.uint64(TaskContext.get().partitionId() % SHARDS)
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], names=["key", "n"])

    for batch in batches:
        texts, langs = _table(batch.column(1), batch.column(0))
        for first, last, _, _, _, words, follows, counts in hashes.chunks(texts):
            *_, (_, grams, _) = _levels(np.repeat(langs[first:last], counts), words, follows, n, filters)
            if len(grams):
                held.append((grams & ~np.uint64(7)) | shard)
                size += len(grams)
            if size >= COUNTED_TOGETHER:
                yield counted()
                size = 0
    if size:
        yield counted()


def _slice(rows: pa.Table) -> pa.Table:
    """The compressed bits of one slice of the filter."""
    bits = np.zeros(SLICE_BITS, np.uint8)
    bits[rows.column("slot").to_numpy() % SLICE_BITS] = 1
    packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
    return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int64()), "bits": pa.array([packed], pa.binary())})


def _filter(frequent: DataFrame) -> bytes:
    """The filter of the phrases with a key in ``frequent``, compressed; its size does not grow with them."""
    width = FILTER_BITS.bit_length() - 1
    slots = frequent.select(F.shiftrightunsigned("key", 64 - width).alias("slot")).distinct()
    slices = slots.withColumn("slice", F.floor(F.col("slot") / SLICE_BITS)).groupBy("slice").applyInArrow(_slice, "slice long, bits binary")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in slices.toLocalIterator():  # at most FILTER_BITS / SLICE_BITS rows of at most 32 KB
        out[r["slice"] * (SLICE_BITS // 8):(r["slice"] + 1) * (SLICE_BITS // 8)] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def mine_shards(rows: DataFrame, max_words: int, support: int) -> list[bytes]:
    """The filters of the phrases of 1 to ``max_words`` words that are locally frequent in a shard.

    ``rows`` has (lang, text as bytes). Occurrences are counted in the tasks first, a few million at a
    time, and then by (phrase hash, shard) over all tasks of the shard.
    """
    spark, filters = rows.sparkSession, []
    local = max(1, -(-support // SHARDS))
    for n in range(1, max_words + 1):
        told = spark.sparkContext.broadcast(list(filters))
        with batches_of(spark, ROWS):
            counts = rows.mapInArrow(lambda it, n=n, told=told: _mine(n, told, it), "key long, n long")
            frequent = counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= local)
            filters.append(_filter(frequent))
        told.unpersist()
        release(spark)
    return filters


class _Block:
    """Words of many texts, whose phrases are counted together."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, data: bytes, starts, stops, words, follows, lang) -> None:
        self.parts.append((data.lower(), *[(x + self.size).astype(np.int32) for x in (starts, stops)], words, follows, lang.astype(np.int32)))
        self.size += len(data) + 1

    def counts(self, names: list[str], filters: list) -> Iterator[pa.RecordBatch]:
        """How often each phrase that passes the filters occurs, and the words of each lang."""
        data = b"\n".join(p[0] for p in self.parts)
        parts, self.parts, self.size = [p[1:] for p in self.parts], [], 0
        starts, stops, words, follows, lang = map(np.concatenate, zip(*parts, strict=True))
        del parts
        totals = np.bincount(lang, minlength=len(names))
        yield _rows(list(names), [b""] * len(names), totals)
        if not len(starts):
            return
        apart = np.append(starts[1:] - stops[:-1] != 1, True)
        apart |= np.frombuffer(data + b"\n", np.uint8)[stops] != 0x20
        keys = np.array([hash64(v.encode()) for v in names], np.uint64)[lang]
        for n, (at, grams, passed) in enumerate(_levels(keys, words, follows, len(filters), filters), 1):
            _, where, times = np.unique(grams[passed], return_index=True, return_counts=True)
            every = at[passed][where]
            for i in range(0, len(every), FOUND):
                place = every[i:i + FOUND]
                found = [data[j:k] for j, k in zip(starts[place].tolist(), stops[place + n - 1].tolist(), strict=True)]
                odd = np.zeros(len(place), bool)
                for j in range(n - 1):
                    odd |= apart[place + j]
                for j in np.flatnonzero(odd).tolist():  # not one blank between its words
                    found[j] = b" ".join(found[j].split())
                yield _rows([names[v] for v in lang[place].tolist()], found, times[i:i + FOUND])


def _rows(names: list[str], found: list[bytes], times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary()), pa.array(times, pa.int64())],
                                      names=["lang", "phrase", "f"])


def _count(told, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters = [np.frombuffer(zlib.decompress(b), np.uint8) for b in told.value]
    hashes, block, names = PieceHashes(), _Block(), {}
    for batch in batches:
        texts, langs = _table(batch.column(1), batch.column(0))
        number = np.array([names.setdefault(v, len(names)) for v in batch.column(0).to_pylist()], np.int64)
        for first, last, data, starts, stops, words, follows, per_row in hashes.chunks(texts):
            block.add(data, starts, stops, words, follows, np.repeat(number[first:last], per_row))
            if block.size >= BLOCK_BYTES:
                yield from block.counts(list(names), filters)
    if block.parts:
        yield from block.counts(list(names), filters)


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 4, support: int = 30) -> DataFrame:
    """(lang, phrase, n_words, f): exact counts of all phrases of 1 to ``max_words`` words with at least ``support``
    occurrences in their lang, and of all words of each lang (empty phrase, n_words 0); written once."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(mine_shards(rows, max_words, support))
    with batches_of(spark, ROWS):
        found = rows.mapInArrow(lambda it: _count(told, it), "lang string, phrase binary, f long")
        exact = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        phrase = F.col("phrase").cast("string")
        return written(exact.filter((F.octet_length("phrase") == 0) | (F.col("f") >= support)).select(
            "lang", phrase.alias("phrase"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("n_words"), "f"),
            "phrase-counts")


def score(counts: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score) of the phrases of two or more words in ``counts``, by their weakest cut.

    Cutting a phrase after k words gives l and r, the counts of its parts, and floor(2000000 a / (l + r)); the
    least score counts, of equal ones that with the smallest k. Computed in decimals, so exact.
    """
    parts = counts.filter("n_words >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    words = F.split("phrase", " ")
    cut = (counts.filter("n_words >= 2").withColumn("w", words)
           .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
           .select("lang", "phrase", "n_words", F.col("f").alias("a"), "k",
                   F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                   F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words")), " ").alias("rest")))
    for part, name in (("first", "l"), ("rest", "r")):
        side = parts.select("lang", F.col("part").alias(part), F.col("pf").alias(name))
        cut = cut.join(side, ["lang", part])
    s = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = cut.withColumn("score", s).groupBy("lang", "phrase", "n_words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return weakest.select("lang", "phrase", "n_words", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"),
                          F.col("m.score").alias("score"))


def covered(counts: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the phrases inside a longer one that has at least ``percent`` of their occurrences."""
    inner = (counts.filter("n_words >= 3").withColumn("w", F.split("phrase", " "))
             .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)))
             .select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), F.col("f").alias("longer")))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = counts.select("lang", "phrase", "f").join(most, ["lang", "phrase"])
    return whole.filter(F.lit(100) * F.col("longer") >= F.lit(percent) * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 4, support: int = 30,
                 percent: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each lang by score: (lang, rank, phrase, a, l, r, n, score).

    Phrases of 2 to ``max_words`` words within pieces of text between the signs ``.,;:!?`` and line ends, with at
    least ``support`` occurrences, overlaps included; A-Z is lower-cased. A phrase inside a longer
    candidate that has ``percent`` of its occurrences is left out. n counts all words of the lang. A null lang counts as ``und``;
    null and empty texts have no words; repeated rows count as often as they occur; other columns are
    not read; a table without frequent phrases gives no rows. Ranks go by score and a, both descending, then
    by the bytes of the phrase.
    """
    counts = phrase_counts(docs, text=text, lang=lang, max_words=max_words, support=support)
    kept = score(counts).join(covered(counts, percent), ["lang", "phrase"], "left_anti")
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    first = kept.withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
