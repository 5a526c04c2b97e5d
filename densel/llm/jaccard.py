"""Jaccard join of word n-gram sets: rare-first prefixes, length, positional and suffix filters, exact verification.

Sets that reach the threshold share an n-gram among the rarest of either (its prefix), so texts are
joined on prefix n-grams. Equal sets are one class from the start. A bucket of texts that share a
prefix n-gram is not turned into all its pairs: each member is first verified against the bucket's
head, the text with most shared n-grams. Jaccard distance obeys the triangle inequality, so a link
of a member that links to the head lies within twice the distance limit of the head; those near
members are compared through their differences from the head, in blocks, and of the others only
pairs of texts that link to no head remain for the plain join. No link is lost, and a group of
thousands of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densel.llm.components import connected_components
from densel.llm.tables import batches_of, release, written
from densel.llm.tokens import BlankHashes, shingle_sets

#: Counters of how often n-grams repeat among the texts that a task reads together; n-grams in one slot share a
#: counter. Any order of n-grams gives right results; this one puts those of many texts last. Fixed size, broadcast.
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
#: N-grams read together.
COUNTED_TOGETHER = 2_000_000
#: Bits that tell the tasks which texts' sets are asked for; false alarms only cost work.
ASKED_BITS = 1 << 22
#: Least and most hash ranges (powers of two) of which the suffix filter knows whether a set's n-grams there are odd in number.
LEAST_BINS, MOST_BINS = 128, 1 << 15
#: Texts, and pairs with both their sets, handed to Python at once.
TEXTS, PAIRS = 1_000, 200
#: Members on either side of a block of differences from one head.
BLOCK = 2_000
#: Rounds of heads before the plain join of what is left.
ROUNDS = 6


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of the batches, whose second column is the text, with their n-gram sets."""
    hashes = BlankHashes()
    for batch in batches:
        for first, sets in shingle_sets(hashes, batch.column(1), k):
            yield batch.slice(first, len(sets)), sets
    pa.default_memory_pool().release_unused()


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count_slots(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.uint32)
    held: list[np.ndarray] = []

    def count() -> None:
        h = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        again = times > 1  # an n-gram of one text only is no news, and would drown the others
        np.add.at(counts, _slot(h[first[again]]), times[again].astype(np.uint32))
        held.clear()

    n = 0
    for _, sets in _sets(k, batches):
        held += sets
        n += sum(map(len, sets))
        if n >= COUNTED_TOGETHER:
            count()
            n = 0
    if n:
        count()
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["slot", "n"])


def slot_counts(rows: DataFrame, k: int) -> np.ndarray:
    """How often n-grams repeat among texts read together, summed by slot over all texts."""
    counts = rows.mapInArrow(lambda it: _count_slots(k, it), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    with batches_of(rows.sparkSession, TEXTS):
        t = counts.toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[t.column("slot").to_numpy()] = t.column("n").to_numpy()
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


PREFIXES = "id long, n long, digest binary, bins binary, prefix array<long>"
_PREFIXES = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bins", pa.binary()),
                       ("prefix", pa.list_(pa.int64()))])


def _bins(s: np.ndarray, p_near: int, q: int) -> bytes:
    """Bits that say in which hash ranges the set has an odd number of n-grams; four ranges to a difference that may be."""
    n = 4 * (2 * len(s) - 2 * least_shared(len(s), len(s), p_near, q))
    width = min(max(LEAST_BINS, 1 << max(n - 1, 0).bit_length()), MOST_BINS).bit_length() - 1
    return np.packbits(np.bincount((s >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width) & 1 == 1).tobytes()


def _prefixes(k: int, p: int, q: int, told, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frequency = told.value
    for rows, sets in _sets(k, batches):
        digests, bins, prefixes = [], [], []
        for s in sets:
            n = len(s)
            bins.append(_bins(s, 2 * p - q, q))
            if not n:
                digests.append(None)
                prefixes.append(np.zeros(0, np.int64))
                continue
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            keep = n - (p * n + q - 1) // q + 1
            f = frequency[_slot(s)]
            if keep < n:
                limit = np.partition(f, keep - 1)[keep - 1]
                c = np.flatnonzero(f <= limit)
            else:
                c = np.arange(n)
            prefixes.append(s[c[np.lexsort((s[c], f[c]))[:keep]]].view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bins, pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))],
            schema=_PREFIXES)


def _asked_sets(k: int, told, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = told.value

    def wanted() -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    for rows, sets in _sets(k, wanted()):
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
             pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "digest", "grams"])


def least_shared(n: int, m: int, p: int, q: int) -> int:
    """Fewest shared n-grams with which sets of n and m reach the similarity p / q."""
    return -(-p * (n + m) // (p + q))


VERIFIED = "a long, b long, n_a long, n_b long, linked boolean, lost binary, added binary"
_VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("linked", pa.bool_()),
                       ("lost", pa.binary()), ("added", pa.binary())])


def _verify(p: int, q: int, p_near: int, differences: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, grams_a, grams_b) at least p_near / q similar, marked whether they link; a's differences from b."""
    for batch in batches:
        out = []
        for a, b, ga, gb in zip(*(batch.column(i) for i in range(4)), strict=True):
            x, y = np.frombuffer(ga.as_py(), np.uint64), np.frombuffer(gb.as_py(), np.uint64)
            need = least_shared(len(x), len(y), max(p_near, 1), q)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = y[at] == x
            shared = int(same.sum())
            if shared < need:
                continue
            lost = added = None
            if differences:
                kept = np.zeros(len(y), bool)
                kept[at[same]] = True
                lost, added = y[~kept].tobytes(), x[~same].tobytes()
            out.append({"a": a.as_py(), "b": b.as_py(), "n_a": len(x), "n_b": len(y),
                        "linked": shared >= least_shared(len(x), len(y), p, q), "lost": lost, "added": added})
        yield pa.RecordBatch.from_pylist(out, schema=_VERIFIED)


PLAUSIBLE = "a long, b long, digest_a binary, digest_b binary"


def _differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many hash ranges the sets of each pair differ for sure; the finer of two is brought to the other's ranges."""
    bits = [np.unpackbits(np.frombuffer(b"".join(z), np.uint8)).reshape(len(z), -1) for z in (x, y)]
    width = min(z.shape[1] for z in bits)
    x, y = (np.bitwise_xor.reduce(z.reshape(len(z), width, -1), axis=2) for z in bits)
    return (x != y).sum(axis=1)


def _could_share(p: int, q: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix filter: pairs whose sets do not differ in more hash ranges than they may in n-grams."""
    for b in batches:
        if b.num_rows:
            x, y = (np.array(b.column(c).to_pylist(), object) for c in ("bins_a", "bins_b"))
            n, m = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
            may = n + m - 2 * -(-p * (n + m) // (p + q))
            ok = np.zeros(len(n), bool)
            sizes = np.array([(len(i) << 32) + len(j) for i, j in zip(x, y, strict=True)], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for part in np.split(at, range(PAIRS, len(at), PAIRS)):
                    ok[part] = _differing(x[part].tolist(), y[part].tolist()) <= may[part]
            yield b.select(["a", "b", "digest_a", "digest_b"]).filter(pa.array(ok))


def _plausible(pairs: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """Distinct candidate pairs (a, b) that pass the suffix filter, with their sets' digests, written."""
    of = lambda c: classes.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "bins", "digest")])
    rows = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    with batches_of(pairs.sparkSession, TEXTS):
        out = written(rows.mapInArrow(lambda it: _could_share(p, q, it), PLAUSIBLE), "pairs")
    release(pairs.sparkSession)
    return out


def _verified(pairs: DataFrame, rows: DataFrame, k: int, p: int, q: int, p_near: int, differences: bool) -> DataFrame:
    """Plausible pairs verified on their sets, which are computed again from the texts.

    Few texts have plausible partners, so hashing those again costs less than keeping all sets. The
    sets are shuffled once for both sides. Texts are told apart by id and digest, so rows that repeat
    an id with another text do no harm, and those that repeat a text too only repeat pairs.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(ASKED_BITS))
    bits = np.zeros(ASKED_BITS // 8, np.uint8)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    at = ids.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    told = rows.sparkSession.sparkContext.broadcast(bits)
    sets = (rows.filter("id is not null").select("id", "text", slot.alias("slot"))
            .mapInArrow(lambda it: _asked_sets(k, told, it), "id long, digest binary, grams binary"))
    of = lambda c: sets.select(F.col("id").alias(c), F.col("digest").alias(f"digest_{c}"), F.col("grams").alias(f"g{c}"))
    both = pairs.join(of("a"), ["a", "digest_a"]).join(of("b"), ["b", "digest_b"]).select("a", "b", "ga", "gb")
    with batches_of(rows.sparkSession, PAIRS):
        out = written(both.mapInArrow(lambda it: _verify(p, q, p_near, differences, it), VERIFIED), "verified")
    release(rows.sparkSession)
    return out


def _block_links(p: int, q: int, group: pa.Table) -> pa.Table:
    """Links between texts near one head, from their differences from it; of each component found, a spanning tree."""
    size = group.column("n_b")[0].as_py()
    rows = [(a, n, linked, asks, set(np.frombuffer(lost, np.uint64).tolist()), set(np.frombuffer(added, np.uint64).tolist()))
            for a, n, linked, asks, lost, added in zip(*(group.column(c).to_pylist() for c in (
                "a", "n_a", "linked", "asks", "lost", "added")), strict=True)]
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (r := root.setdefault(i, i)) != i:
            root[i] = root.setdefault(r, r)
            i = r
        return i

    head = None
    for a, _, linked, *_ in rows:  # texts that link to the head are one component already
        if linked:
            head = a if head is None else head
            root[top(a)] = top(head)
    links = []
    targets = [r for r in rows if not r[3]]
    for a, n, _, _, lost, added in (r for r in rows if r[3]):
        for b, m, _, _, lost_b, added_b in targets:
            if a == b:
                continue
            need = least_shared(n, m, p, q)
            if size - max(len(lost), len(lost_b)) + min(len(added), len(added_b)) < need or top(a) == top(b):
                continue
            shared = size - len(lost) - len(lost_b) + len(lost & lost_b) + len(added & added_b)
            if shared >= need:
                root[top(a)] = top(b)
                links.append((a, b))
    return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _near_head_links(near: DataFrame, p: int, q: int) -> DataFrame:
    """Links between texts near a head of which at least one does not link to it, in blocks of BLOCK by BLOCK."""
    per = near.groupBy("b").agg(F.count(F.lit(1)).alias("_n"), F.sum((~F.col("linked")).cast("long")).alias("_open"))
    rows = near.join(per.filter("_open > 0"), "b").withColumns({
        "_asks_of": F.ceil(F.col("_open") / BLOCK).cast("int"), "_targets_of": F.ceil(F.col("_n") / BLOCK).cast("int")})
    mine = lambda of: F.pmod(F.xxhash64("a"), F.col(of)).cast("int")
    asking = rows.filter(~F.col("linked")).withColumns({
        "asks": F.lit(True), "_q": mine("_asks_of"), "_t": F.explode(F.sequence(F.lit(0), F.col("_targets_of") - 1))})
    targets = rows.withColumns({
        "asks": F.lit(False), "_t": mine("_targets_of"), "_q": F.explode(F.sequence(F.lit(0), F.col("_asks_of") - 1))})
    columns = ["b", "_q", "_t", "asks", "a", "n_a", "n_b", "linked", "lost", "added"]
    return (asking.select(columns).unionByName(targets.select(columns)).groupBy("b", "_q", "_t")
            .applyInArrow(lambda g: _block_links(p, q, g), "a long, b long"))


def _length_fits(n: Column, m: Column, p: int, q: int) -> Column:
    return F.least(n, m) * F.lit(q) >= F.greatest(n, m) * F.lit(p)


def _shared_tokens(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("token")
    return rows.join(counts, "token")


def jaccard_classes(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, key: str = "doc_id",
                    text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership, links): texts whose sets of distinct k-word n-grams reach the similarity p / q, p over q/2.

    Words: A-Z lower-cased, cut at ASCII white space; a text of fewer than k words is one n-gram of all
    of them; a text without words (or null) has an empty set and links with nothing. N-grams are
    compared by 64-bit hashes. Membership has a row per input row: id, n (set size) and rep, the
    smallest id with an equal set (null for empty sets and null ids, which link with nothing). ``links``
    (a, b) connect representatives: every pair that reaches the threshold is connected through them,
    and each of them reaches it.
    """
    if not q < 2 * p <= 2 * q:
        raise ValueError("the similarity must be over 1/2 and at most 1")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    spark = docs.sparkSession
    frequency = spark.sparkContext.broadcast(slot_counts(rows, k))
    with batches_of(spark, TEXTS):
        made = written(rows.mapInArrow(lambda it: _prefixes(k, p, q, frequency, it), PREFIXES), "prefixes")
    known = made.filter("n > 0 and id is not null")
    classes = written(known.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"),
                                                  F.first("bins").alias("bins"), F.first("prefix").alias("prefix")),
                      "set-classes")
    release(spark)
    member = made.select("id", "n", "digest").join(classes.select(F.col("digest").alias("_d"), "rep"),
                                                   (F.col("digest") == F.col("_d")) & F.col("id").isNotNull(), "left")
    membership = member.select("id", "n", "rep")
    tokens = classes.select(F.col("rep").alias("a"), "n", F.posexplode("prefix").alias("pos", "token"))
    active = written(_shared_tokens(tokens), "prefix-tokens")
    release(spark)
    p_near = 2 * p - q
    links, compared = [], []
    for _ in range(ROUNDS):
        shared = active.groupBy("a").agg(F.count(F.lit(1)).alias("_c"))
        ranked = active.join(shared, "a")
        heads = ranked.groupBy("token").agg(F.max(F.struct("_c", F.col("a").alias("b"), F.col("n").alias("n_b"))).alias("_h"))
        headed = written(ranked.join(heads, "token").select("token", "a", "n", "pos", "_h.b", "_h.n_b"), "headed")
        pairs = (headed.filter((F.col("a") != F.col("b")) & _length_fits(F.col("n"), F.col("n_b"), p_near, q))
                 .select("a", "b").distinct())
        pairs = _plausible(pairs, classes, p_near, q)
        near = _verified(pairs, rows, k, p, q, p_near, True)
        links.append(near.filter("linked").select("a", "b"))
        links.append(_near_head_links(near, p, q))
        compared.append(near.filter("not linked").select("a", "b"))
        left = headed.filter("a <> b").join(near.filter("linked").select("a", "b"), ["a", "b"], "left_anti")
        active = written(_shared_tokens(left.select("token", "a", "n", "pos")), "prefix-tokens")
        per = active.groupBy("token").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.sum("m")).first()
        if not per[0] or per[0] <= 2 * per[1]:
            break
    # texts near one head that do not link to it have been compared with each other
    active = active.withColumn("near", F.array().cast("array<long>"))
    if compared:
        near = reduce(DataFrame.unionByName, compared).groupBy("a").agg(F.collect_set("b").alias("near"))
        active = written(active.drop("near").join(near, "a", "left").withColumn(
            "near", F.coalesce("near", F.array().cast("array<long>"))), "prefix-tokens")
        release(spark)
    other = active.select(F.col("token").alias("_token"), F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"),
                          F.col("near").alias("near_b"))
    need = F.ceil(F.lit(p) * (F.col("n") + F.col("n_b")) / F.lit(p + q))
    # positional filter: before a shared prefix n-gram two sets share at most the places of either, after it the rest
    most = (F.least("pos", "pos_b") + F.lit(1) + F.least(F.col("n") - F.col("pos") - 1, F.col("n_b") - F.col("pos_b") - 1))
    both = active.join(other, (active["token"] == other["_token"]) & (F.col("a") < F.col("b"))
                       & _length_fits(F.col("n"), F.col("n_b"), p, q) & (most >= need) & ~F.arrays_overlap("near", "near_b"))
    after = F.least(F.col("n") - F.max("pos") - 1, F.col("n_b") - F.max("pos_b") - 1)
    pairs = both.groupBy("a", "b", "n", "n_b").agg(after.alias("after"), F.least(F.max("pos"), F.max("pos_b")).alias("before"))
    # and again at the last shared prefix n-gram
    pairs = pairs.filter(F.col("before") + F.lit(1) + F.col("after") >= need)
    pairs = _plausible(pairs, classes, p, q)
    links.append(_verified(pairs, rows, k, p, q, p, False).filter("linked").select("a", "b"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return membership, every


def jaccard_components(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(id, n, component): set size of each row, and the smallest id reachable over links, its own included."""
    membership, links = jaccard_classes(docs, k, p, q, key, text)
    joined = connected_components(links)
    return membership.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "id", "n", F.coalesce("component", "rep", "id").alias("component"))


def keep_one(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """One document of each group of ``docs`` (doc_id, text, any other columns): that with the smallest doc_id.

    Documents without words, and rows with a null doc_id, belong to no group and stay. Different texts that share a
    doc_id are different documents, of which the one with the smallest hash counts as the smaller; of equal
    rows (doc_id and text) with words one stays.
    """
    repeats = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    repeats = written(repeats.select(F.col("doc_id").alias("_id")), "repeated-ids")
    if repeats.isEmpty():
        gone = jaccard_components(docs, k, p, q).filter("component <> id").select(F.col("id").alias("_id")).distinct()
        return docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    # repeated ids: each (doc_id, text) is a document with a key of its own
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    named = docs.filter("doc_id is not null").select("doc_id", key.alias("_sid"), "text")
    told = written(jaccard_components(named, k, p, q, key="_sid").filter("n > 0").select("id", "component").distinct(), "keep-classes")
    ids = named.select("doc_id", "_sid").distinct()
    first = (told.join(ids, told["id"] == ids["_sid"]).groupBy("component").agg(F.min(F.struct("doc_id", "_sid")).alias("_m")))
    gone = (told.join(first, "component").filter(F.col("id") != F.col("_m._sid")).select(F.col("id").alias("_gone")).distinct())
    keyed = docs.withColumn("_sid_of_row", F.when(F.col("doc_id").isNotNull(), key))
    kept = keyed.join(gone, F.col("_sid_of_row") == F.col("_gone"), "left_anti")
    # of the rows of one kept key with words, the first stays; only keys that are repeated are numbered
    again = written(named.groupBy("_sid").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
                    .join(told.select(F.col("id").alias("_sid")), "_sid", "left_semi").select(F.col("_sid").alias("_again")), "repeated-rows")
    turn = F.row_number().over(Window.partitionBy("_sid_of_row").orderBy(F.lit(1)))
    once = (kept.join(again, F.col("_sid_of_row") == F.col("_again"), "left_semi").withColumn("_turn", turn)
            .filter("_turn = 1").drop("_turn"))
    return kept.join(again, F.col("_sid_of_row") == F.col("_again"), "left_anti").unionByName(once).drop("_sid_of_row")
