"""Positional inverted index of training texts, and phrase and proximity search of benchmark items in it.

The index is a Parquet table of segments. A segment is the inverted index of some whole documents:
its terms as sorted 64-bit hashes, and for each term the sorted list of its positions. A search reads
one segment at a time in one task, so it needs no shuffle and no task holds more than a segment: a segment
is a row group of its file and an Arrow batch of its own, however many a file has.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.llm.tables import batches_of, written
from densel.llm.tokens import WordIds, alnum_words, distinct, hash64

#: Positions left free between two documents of a segment; more than a phrase and its slop.
GAP = 256
SEGMENT_WORDS = 1_000_000
#: Texts that a Python worker gets at once: rows, and bytes reached by the last of them.
TEXTS, TEXT_BYTES = 10_000, 4 << 20
#: Phrases looked up at once, and postings of their rarest terms followed at once (or one phrase's).
PHRASES, POSTINGS = 1 << 15, 500_000
#: Benchmark words searched in one pass over the index (8 bytes each, broadcast); more words take more passes.
PASS_WORDS = 2_000_000

SEGMENT = ("keys array<string>, starts binary, lengths binary, terms binary, ends binary, positions binary")
_SEGMENT = pa.schema([("keys", pa.list_(pa.string())), ("starts", pa.binary()), ("lengths", pa.binary()),
                      ("terms", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary())])


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as all their first bytes, all their second bytes and so on, which pack better."""
    return x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _segment(keys: list, ids: list[np.ndarray], vocabulary: WordIds) -> pa.RecordBatch:
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]).astype(np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    # 32 bits hold every place: a text has less than 2 ** 31 bytes, so 2 ** 30 words, and the gaps are few
    where = np.arange(len(flat), dtype=np.int32) + np.repeat(np.arange(len(ids), dtype=np.int32) * np.int32(GAP), lengths)
    hashes = vocabulary.hashes()
    by_hash = np.argsort(hashes)
    place = np.empty(len(by_hash), dtype=np.int32)
    place[by_hash] = np.arange(len(by_hash), dtype=np.int32)
    term = place[flat]
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(hashes)))
    blob = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([keys], pa.list_(pa.string())), blob(starts, np.int64), blob(lengths, np.int64),
         blob(hashes[by_hash], np.uint64),
         *[pa.array([_planes(x)], pa.binary()) for x in (ends, where[order])]], schema=_SEGMENT)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, ids, n, vocabulary = [], [], 0, WordIds()
    for batch in batches:
        for i in range(batch.num_rows):
            keys.append(batch.column(0)[i].as_py())
            ids.append(vocabulary.numbers(alnum_words(batch.column(1)[i].as_py())))
            n += len(ids[-1])
            if n >= SEGMENT_WORDS or len(keys) >= 50_000:
                yield _segment(keys, ids, vocabulary)
                keys, ids, n, vocabulary = [], [], 0, WordIds()
    if keys:
        yield _segment(keys, ids, vocabulary)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional inverted index of the whole texts, written to the shared scratch folder: a row per segment.

    Every document is in one segment, also those without words (null or empty text); keys are kept as
    strings, null keys and repeated keys as they are. A text longer than a segment makes its own.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    with batches_of(rows.sparkSession, TEXTS, TEXT_BYTES):
        return written(rows.mapInArrow(_index, SEGMENT), "token-postings",
                       **{"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"})


class _Segment:
    def __init__(self, row: dict):
        self.keys = row["keys"]
        self.starts, self.lengths = (np.frombuffer(row[c], dtype=np.int64) for c in ("starts", "lengths"))
        self.ends, self.positions = (_numbers(row[c]) for c in ("ends", "positions"))
        self.terms = np.frombuffer(row["terms"], dtype=np.uint64)
        self.span = int(self.starts[-1] + self.lengths[-1]) + 2 * GAP if len(self.starts) else 1
        counts = np.diff(self.ends, prepend=np.int32(0))
        self.counts = counts
        # posting lists of all terms in one ascending array: term * span + position
        self.lists = np.repeat(np.arange(len(counts), dtype=np.int64) * self.span + GAP, counts)
        self.lists += self.positions

    def find(self, phrases: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (phrase, start), the occurrences of phrases (rows of term hashes), intersecting from the rarest term."""
        if not len(self.terms):
            return
        for i in range(0, len(phrases), PHRASES):
            for phrase, start in self._find(phrases[i:i + PHRASES], slop):
                yield phrase + i, start

    def _find(self, phrases: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = phrases.shape[1]
        at = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        whole = np.flatnonzero((self.terms[at] == phrases).all(axis=1))
        at = at[whole]
        order = np.argsort(self.counts[at], axis=1, kind="stable")
        costs = np.cumsum(np.take_along_axis(self.counts[at], order[:, :1], axis=1)[:, 0], dtype=np.int64)
        first = 0
        while first < len(whole):  # phrases whose rarest lists hold so many postings together, or one phrase
            base = costs[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(costs, base + POSTINGS, side="right")))
            rows = np.arange(first, last)
            rare = at[rows, order[rows, 0]]
            n = self.counts[rare].astype(np.int64)
            phrase = np.repeat(rows, n)
            begin = np.repeat(self.ends[rare] - n - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            start = self.positions[begin + np.arange(len(phrase))] - order[phrase, 0]
            for j in range(1, width):
                if not len(phrase):
                    break
                o = order[phrase, j]
                low = at[phrase, o] * self.span + start + o + GAP - slop
                i = np.minimum(np.searchsorted(self.lists, low), len(self.lists) - 1)
                ok = (self.lists[i] >= low) & (self.lists[i] <= low + 2 * slop)
                phrase, start = phrase[ok], start[ok]
            if len(phrase):
                yield whole[phrase], start
            first = last


MATCHES = "key string, n_words long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCHES = pa.schema([("key", pa.string()), ("n_words", pa.int64()), ("spans", _SPANS),
                      ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])


def _windows(items: list[tuple[str, bytes | None]], window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct windows by width: (term hashes, item number) rows."""
    by_width: dict[int, dict] = {}
    for number, (_, text) in enumerate(items):
        h = [hash64(w) for w in alnum_words(text)]
        width = min(window, len(h))
        for i in range(len(h) - width + 1 if h else 0):
            by_width.setdefault(width, {})[(tuple(h[i:i + width]), number)] = None
    return {w: (np.array([p for p, _ in rows], dtype=np.uint64).reshape(-1, w), np.array([n for _, n in rows]))
            for w, rows in by_width.items()}


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges that overlap or touch, as one each, ascending."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    np.greater(starts[1:], ends[:-1], out=new[1:])
    return starts[new], ends[np.append(new[1:], True)]


def _matches(seg: _Segment, names: list[str], windows: dict, slop: int) -> pa.RecordBatch:
    n_docs = len(seg.keys)
    exact, near = set(), set()  # document * items + item
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for width, (phrases, item) in windows.items():
        for wide in ([0, slop] if slop else [0]):
            at = np.zeros(seg.span, bool)
            for phrase, start in seg.find(phrases, wide):
                doc = np.searchsorted(seg.starts, start, side="right") - 1
                ok = doc >= 0
                if not wide:
                    ok &= start + width <= seg.starts[doc] + seg.lengths[doc]
                phrase, start, doc = phrase[ok], start[ok], doc[ok]
                (near if wide else exact).update(distinct(doc * len(names) + item[phrase]).tolist())
                if not wide:
                    at[start] = True
            if not wide:
                starts.append(np.flatnonzero(at))
                ends.append(starts[-1] + width)
    start, end = _joined(np.concatenate(starts), np.concatenate(ends))
    doc = np.searchsorted(seg.starts, start, side="right") - 1
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(x - seg.starts[doc], pa.int64()) for x in (start, end)], ["start", "end"]))
    lists = [[[] for _ in range(n_docs)] for _ in range(2)]
    for which, pairs in enumerate((exact, near - exact)):
        for d, number in (divmod(x, len(names)) for x in pairs):
            lists[which][d].append(names[number])
    return pa.RecordBatch.from_arrays(
        [pa.array(seg.keys, pa.string()), pa.array(seg.lengths, pa.int64()), spans,
         *[pa.array([sorted(set(x)) for x in which], pa.list_(pa.string())) for which in lists]], schema=_MATCHES)


def _search(names, windows, slop, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _matches(_Segment({c: batch.column(c)[i].as_py() for c in batch.schema.names}), names, windows, slop)


def search(index: DataFrame, items: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """Occurrences of every window of the items in the indexed texts: a row per indexed document.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one
    without words none. ``spans``: the words covered by exact occurrences, as merged half-open word
    ranges; ``items``: keys of the items with an exact occurrence (sorted strings; a null item_id is
    ignored). With ``slop`` above 0, ``near_items`` has those of which some window's words all lie
    within ``slop`` words of their place, and no window exactly. For each window the posting lists are
    intersected from the rarest, shifted by the word's offset. ``items`` has item_id and text; their
    windows are broadcast, at most PASS_WORDS words to a pass; a larger benchmark takes several
    passes over the index, whose rows are then merged by document. The rows found are written, as
    segments reach the Python workers one at a time only in a job run here.
    """
    if not 0 <= slop < GAP // 2 or not 0 < window < GAP // 2:
        raise ValueError("window and slop must stay below half the gap between documents")
    spark = index.sparkSession
    texts = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("id"),
                                                       F.col("text").cast("binary").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-n_bytes * window // (2 * PASS_WORDS)))
    told, out = [], []
    for p in range(passes):
        part = texts.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).collect()
        rows = sorted((r["id"], bytes(r["text"]) if r["text"] is not None else None) for r in part)
        told.append(spark.sparkContext.broadcast(([r[0] for r in rows], _windows(rows, window))))
        out.append(index.mapInArrow(lambda it, b=told[-1]: _search(b.value[0], b.value[1], slop, it), MATCHES))
    found = out[0]
    if passes > 1:  # all in one job, so that each pass numbers the rows alike
        out = [x.withColumn("_row", F.monotonically_increasing_id()) for x in out]
        found = functools.reduce(DataFrame.unionByName, out)
    with batches_of(spark, 1):
        found = written(found, "token-matches")
    for b in told:
        b.unpersist()
    return found if passes == 1 else _merged(found)


def _merged(all_rows: DataFrame) -> DataFrame:
    """Rows of several passes over one index, by row; spans may then overlap and are joined."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    joined = F.aggregate(spans, F.expr("cast(array() as array<struct<start:long,end:long>>)"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s))))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return (all_rows.groupBy("_row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"),
                                         joined.alias("spans"), union("items").alias("items"),
                                         union("near_items").alias("_near"))
            .select("key", "n_words", "spans", "items", F.array_except("_near", "items").alias("near_items")))


def n_hit(spans):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def contaminated(n_words, hits, share: int = 20):
    """The contamination rule: at least 1 word in ``share`` lies in an occurrence."""
    return (hits > 0) & (F.lit(share) * hits >= n_words)
