"""Exact k-nearest-neighbour joins and kNN log-density (inventory C1, C2, D1, D2, D8-D10).

Spark has no kNN join, so the exact search is a *blocked* join:

* references of each group (term) are dealt into blocks of at most ``ref_block_rows`` rows, and the
  queries of a block of references into query blocks, so every (query block, reference block)
  pair that may hold a neighbour meets in exactly one cogroup;
* with several blocks to a group, blocks follow the cells of pivots and a query meets only cells that
  the triangle inequality leaves open (``densel.operators.pruned``); a group of one block is met whole;
* each cogroup computes one NumPy distance block (``applyInArrow``: vectors arrive as Arrow
  list columns, in the type they are given in, and become matrices without per-row Python) and keeps
  the local best ``k+1`` per query;
* a second shuffle merges the per-block candidates per query: as a sorted
  ``array<double>`` when only the k-th distance is needed, or as rows cut by a
  ``row_number`` window partitioned by query when neighbour ids are needed.

Group sizes never decide task sizes: a term holding a third of all rows simply
gets more reference blocks, and every task sees at most one block pair.
Only per-group counts, the pivots and per-cell counts (bounded numbers) reach the driver. Query ids are unique.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densel.functions.expressions import log_gamma_half_plus_one
from densel.operators.pruned import BLOCK_VALUES, grown_rows, pruned_candidates
from densel.session import ensure_shipped

EPSILON = 1e-10  # fixed value: clamp of the k-th distance before the log
# Block sizes bound one task's memory: a 16384 x 384 float64 reference block is 50 MB, and the
# distance matrix is built in row chunks of ~64 MB. Shuffle volume is about
# |Q|·(reference blocks) + |R|·(query blocks) vectors, so blocks are as large as memory allows.
DEFAULT_REF_BLOCK_ROWS = 16384
DEFAULT_QUERY_BLOCK_ROWS = 8192
_MAX_LITERAL_GROUPS = 100_000  # group directory is inlined as a literal map up to this size

_ALL = "__all__"


# ------------------------------------------------------------------ kernel
def _matrix(tbl: pa.Table, col: str) -> np.ndarray:
    """An Arrow ``list<float|double>`` column as an (n, d) float64 matrix, without per-row Python."""
    arr = tbl.column(col).combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0), dtype=np.float64)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) % n:
        raise ValueError("vectors of different lengths in one block")
    return flat.reshape(n, len(flat) // n)


def _list_column(values: np.ndarray) -> pa.Array:
    """(n, w) matrix -> Arrow list<double> column (one list per row)."""
    n, w = values.shape
    offsets = pa.array(np.arange(0, n * w + 1, max(1, w), dtype=np.int64)[:n + 1])
    big = pa.LargeListArray.from_arrays(offsets, pa.array(values.ravel(), type=pa.float64()))
    return big.cast(pa.list_(pa.float64()))   # 32-bit offsets: a query block keeps n·w below 2^31 (query_rows_for)


def _normalise(m: np.ndarray, zero_policy: str) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    if zero_policy == "keep":
        safe = np.where(norms > 0, norms, 1.0)
        return m / safe
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / norms


PAIRS_PER_CHUNK = 2 << 20   # (query, reference) scores held at once: 16 MB of float64
VALUES_PER_SLAB = 4 << 20   # components gathered at once for the exact recompute: 32 MB of float64
_U64 = float(np.finfo(np.float64).eps) / 2


def _rows_per_chunk(n_ref: int) -> int:
    return max(1, PAIRS_PER_CHUNK // max(1, n_ref))


def _exact_values(q: np.ndarray, r: np.ndarray, qi: np.ndarray, ri: np.ndarray, metric: str) -> np.ndarray:
    """Σ(x−y)² (or x·y) of the given pairs, a bounded slab of components at a time."""
    out = np.empty(len(qi), dtype=np.float64)
    step = max(1, VALUES_PER_SLAB // max(1, q.shape[1]))
    for s in range(0, len(qi), step):
        x, y = q[qi[s:s + step]], r[ri[s:s + step]]
        if metric == "ip":
            out[s:s + step] = (x * y).sum(axis=1)
        else:
            x -= y
            out[s:s + step] = (x * x).sum(axis=1)
    return out


class _References:
    """A block's references with what every chunk of queries needs of them: the finite ones and their squared lengths."""

    def __init__(self, r: np.ndarray):
        self.all = r
        ok = np.isfinite(r).all(axis=1)
        self.good, self.bad = np.flatnonzero(ok), np.flatnonzero(~ok)
        self.finite = r if ok.all() else r[self.good]
        self.squares = (self.finite * self.finite).sum(axis=1)
        self.longest = float(self.squares.max(initial=0.0))


def _near_pairs(q: np.ndarray, refs: _References, kk: int, metric: str):
    """Pairs ``(qi, ri, value)`` that hold the ``kk`` nearest references of each query, by query; not ordered by value.

    References with a non-finite component have no distance: they come after all others, with value
    NaN, so they fill places only where finite references run out; a non-finite query has NaN to all.
    Candidates are the pairs within twice the rounding error of the GEMM score of the query's kk-th
    score (so the true kk nearest and all ties are among them); their values are recomputed as
    Σ(x−y)². The caller bounds ``len(q)·len(refs)``, which bounds the candidates however many ties.
    """
    m, n = len(q), len(refs.all)
    q_ok = np.isfinite(q).all(axis=1)
    qs, rs, rf = np.flatnonzero(q_ok), refs.good, refs.finite
    qi = ri = np.zeros(0, np.int64)
    if len(qs) and len(rs):
        qf = q if len(qs) == m else q[qs]
        if kk < len(rs):
            qq = (qf * qf).sum(axis=1)
            sc = qf @ rf.T
            sc *= -1.0 if metric == "ip" else -2.0
            if metric != "ip":
                sc += qq[:, None]
                sc += refs.squares[None, :]
                np.maximum(sc, 0, out=sc)
            margin = 8.0 * q.shape[1] * _U64 * (qq + refs.longest)
            thr = np.partition(sc, kk - 1, axis=1)[:, kk - 1] + margin + 1e-300
            qi, ri = np.nonzero(sc <= thr[:, None])
            del sc
        else:
            qi, ri = np.divmod(np.arange(len(qs) * len(rs)), len(rs))
        qi, ri = qs[qi], rs[ri]
    val = _exact_values(q, refs.all, qi, ri, metric)
    # pairs without a distance: all of a non-finite query's, and non-finite references where places are left
    bad_q = np.flatnonzero(~q_ok)
    more = [(np.repeat(bad_q, n), np.tile(np.arange(n), len(bad_q)))]
    if len(refs.bad) and kk > len(rs):
        more.append((np.repeat(qs, len(refs.bad)), np.tile(refs.bad, len(qs))))
    if sum(len(x) for x, _ in more):
        qi, ri = (np.concatenate([a, *[x[k] for x in more]]) for k, a in ((0, qi), (1, ri)))
        val = np.concatenate([val, np.full(len(qi) - len(val), np.nan)])
        order = np.argsort(qi, kind="stable")
        qi, ri, val = qi[order], ri[order], val[order]
    return qi, ri, val


def _best_pairs(q: np.ndarray, refs: _References, rid: np.ndarray, kk: int, metric: str):
    """The ``kk`` nearest references of each query as ``(qi, ri, value, rank)``, by value and then ``rid``."""
    qi, ri, val = _near_pairs(q, refs, kk, metric)
    order = np.lexsort((rid[ri], -val if metric == "ip" else val, qi))   # NaN sorts last
    qi, ri, val = qi[order], ri[order], val[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(q)))[qi]
    keep = rank < kk
    return qi[keep], ri[keep], val[keep], rank[keep]


def _best_scores(q: np.ndarray, refs: _References, kk: int, metric: str) -> np.ndarray:
    """The ``kk`` least scores of each query, ascending, NaN last: squared L2 or negated inner product."""
    qi, _, val = _near_pairs(q, refs, kk, metric)
    place = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(q)))[qi]
    out = np.full((len(q), int(place.max(initial=0)) + 1), np.nan)
    out[qi, place] = -val if metric == "ip" else val
    out.sort(axis=1)
    return out[:, :kk]


_KTH_SCHEMA = pa.schema([("_qid", pa.int64()), ("_qg", pa.string()), ("_g", pa.string()), ("_rb", pa.int64()),
                         ("_near", pa.list_(pa.float64()))])
_TOPK_SCHEMA = pa.schema([("_qid", pa.int64()), ("_g", pa.string()), ("_rb", pa.int64()), ("_rid", pa.int64()),
                          ("_d", pa.float64())])
MERGE_FANOUT = 64  # at most this many blocks' candidates meet in one merge group


def _make_kth_kernel(keep: int, normalise: bool, zero_policy: str, metric: str):
    def kernel(qt: pa.Table, rt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or rt.num_rows == 0:
            return _KTH_SCHEMA.empty_table()
        g = rt.column("_g")[0].as_py()
        q, r = _matrix(qt, "_qv"), _matrix(rt, "_rv")
        if normalise:
            q, r = _normalise(q, zero_policy), _normalise(r, zero_policy)
        kk = min(keep, r.shape[0])
        out = np.empty((q.shape[0], kk), dtype=np.float64)
        step, refs = _rows_per_chunk(r.shape[0]), _References(r)
        for s in range(0, q.shape[0], step):
            out[s:s + step] = _best_scores(q[s:s + step], refs, kk, metric)   # ascending; negated back after the merge
        rb = int(rt.column("_rb")[0].as_py())
        return pa.table({"_qid": qt.column("_qid").combine_chunks().cast(pa.int64()),
                         "_qg": qt.column("_qg").combine_chunks().cast(pa.string()),
                         "_g": pa.array([g] * qt.num_rows, type=pa.string()),
                         "_rb": pa.array(np.full(qt.num_rows, rb, dtype=np.int64)),
                         "_near": _list_column(out)}, schema=_KTH_SCHEMA)
    return kernel


def _make_position_kernel(ks: Sequence[int], normalise: bool, zero_policy: str):
    """Squared distances at positions min(k, n−1) of each k, from a group's only block: a number for each k, not k+1 of them."""
    def kernel(qt: pa.Table, rt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or rt.num_rows == 0:
            return _KTH_SCHEMA.empty_table()
        q, r = _matrix(qt, "_qv"), _matrix(rt, "_rv")
        if normalise:
            q, r = _normalise(q, zero_policy), _normalise(r, zero_policy)
        n, keep = len(r), max(ks) + 1
        at = np.array([min(k, n - 1) for k in ks])
        out = np.empty((len(q), len(ks)))
        step, refs = _rows_per_chunk(n), _References(r)
        for s in range(0, len(q), step):
            out[s:s + step] = _best_scores(q[s:s + step], refs, min(keep, n), "l2")[:, at]
        same: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(qt.column("_qid").to_pylist(), qt.column("_qg").to_pylist(), strict=True)):
            same.setdefault(key, []).append(i)
        first = np.array([rows[0] for rows in same.values()])
        for rows in same.values():
            if len(rows) > 1:   # rows of one id are one query, whose distances are theirs together
                every = np.concatenate([_best_scores(q[i:i + 1], refs, min(keep, n), "l2")[0] for i in rows])
                out[rows[0]] = np.sort(every)[at]
        g, rb = rt.column("_g")[0].as_py(), int(rt.column("_rb")[0].as_py())
        took = pa.array(first)
        return pa.table({"_qid": qt.column("_qid").take(took).combine_chunks().cast(pa.int64()),
                         "_qg": qt.column("_qg").take(took).combine_chunks().cast(pa.string()),
                         "_g": pa.array([g] * len(first), type=pa.string()),
                         "_rb": pa.array(np.full(len(first), rb, dtype=np.int64)),
                         "_near": _list_column(out[first])}, schema=_KTH_SCHEMA)
    return kernel


def _make_topk_kernel(keep: int, normalise: bool, zero_policy: str, metric: str):
    def kernel(qt: pa.Table, rt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or rt.num_rows == 0:
            return _TOPK_SCHEMA.empty_table()
        g = rt.column("_g")[0].as_py()
        q, r = _matrix(qt, "_qv"), _matrix(rt, "_rv")
        if normalise:
            q, r = _normalise(q, zero_policy), _normalise(r, zero_policy)
        rid = rt.column("_rid").to_numpy().astype(np.int64)
        qid = qt.column("_qid").to_numpy().astype(np.int64)
        kk = min(keep, r.shape[0])
        qs, rs, ds = [], [], []
        step, refs = _rows_per_chunk(r.shape[0]), _References(r)
        for s in range(0, q.shape[0], step):
            qi, ri, val, _ = _best_pairs(q[s:s + step], refs, rid, kk, metric)
            qs.append(qid[s + qi])
            rs.append(rid[ri])
            ds.append(val)
        n = int(sum(len(x) for x in qs))
        rb = int(rt.column("_rb")[0].as_py())
        return pa.table({"_qid": pa.array(np.concatenate(qs), type=pa.int64()),
                         "_g": pa.array([g] * n, type=pa.string()),
                         "_rb": pa.array(np.full(n, rb, dtype=np.int64)),
                         "_rid": pa.array(np.concatenate(rs), type=pa.int64()),
                         "_d": pa.array(np.concatenate(ds), type=pa.float64())}, schema=_TOPK_SCHEMA)
    return kernel


# ------------------------------------------------------------------ planning
def query_rows_for(k: int, base: int) -> int:
    """Query block size: a block's (k+1) distances per query stay far below the 2^31 values of an Arrow list column."""
    return max(1, min(base, (1 << 28) // (int(k) + 1)))


def _group_stats(df: DataFrame, gcol: str, vcol: str) -> tuple[dict, int]:
    """One pass: rows per group and the common vector length (checked equal everywhere)."""
    rows = (df.groupBy(gcol).agg(F.count("*").alias("n"), F.min(F.size(vcol)).alias("lo"),
                                 F.max(F.size(vcol)).alias("hi"))
            .limit(_MAX_LITERAL_GROUPS + 1).collect())
    if len(rows) > _MAX_LITERAL_GROUPS:
        raise ValueError(f"more than {_MAX_LITERAL_GROUPS} reference groups for the literal block directory")
    dims = {r["lo"] for r in rows} | {r["hi"] for r in rows}
    if len(dims) > 1:
        raise ValueError(f"vector lengths differ: {sorted(d for d in dims if d is not None)}")
    return {r[0]: int(r["n"]) for r in rows}, (dims.pop() if dims else 0)


def _literal_map(d: dict, value_type: str = "bigint") -> Column:
    if not d:
        return F.create_map().cast(f"map<string,{value_type}>")
    items = []
    for k, v in d.items():
        items += [F.lit(str(k)), F.lit(v)]
    return F.create_map(*items)


def _blocked_inputs(queries: DataFrame, refs: DataFrame, *, query_id: str, query_vec: str,
                    query_group: str | None, ref_id: str, ref_vec: str, ref_group: str | None,
                    exclude_same_group: bool, ref_block_rows: int, query_block_rows: int, grow_refs: bool):
    spark = queries.sparkSession
    ensure_shipped(spark)
    q = queries.filter(F.col(query_vec).isNotNull()).select(
        F.col(query_id).cast("bigint").alias("_qid"),
        (F.col(query_group).cast("string") if query_group else F.lit(None).cast("string")).alias("_qg"),
        F.col(query_vec).alias("_qv"))
    r = refs.filter(F.col(ref_vec).isNotNull()).select(
        F.col(ref_id).cast("bigint").alias("_rid"),
        (F.col(ref_group).cast("string") if ref_group else F.lit(_ALL)).alias("_g"),
        F.col(ref_vec).alias("_rv")).filter(F.col("_g").isNotNull())   # a reference without a group is in no group
    counts, dim = _group_stats(r, "_g", "_rv")
    if grow_refs:
        ref_block_rows = max(ref_block_rows, BLOCK_VALUES // max(1, dim))
    blocks = {g: max(1, math.ceil(n / ref_block_rows)) for g, n in counts.items()}
    if queries is refs and query_group == ref_group and query_vec == ref_vec:
        n_q = sum(counts.values())  # self-join: the reference statistics already count the queries
    else:
        qn = q.agg(F.count("*").alias("n"), F.min(F.size("_qv")).alias("lo"), F.max(F.size("_qv")).alias("hi")).first()
        n_q = int(qn["n"])
        if n_q and counts and not (qn["lo"] == qn["hi"] == dim):
            raise ValueError(f"query vectors ({qn['lo']}..{qn['hi']}) and references ({dim}) differ in length")
    return q, r, counts, dim, blocks, n_q


def _every_block(q: DataFrame, r: DataFrame, blocks: dict, n_q: int, exclude_same_group: bool, query_block_rows: int):
    """Both sides dealt so that every query meets every reference block of its groups."""
    spark = q.sparkSession
    total_rb = sum(blocks.values()) or 1
    min_tasks = 2 * spark.sparkContext.defaultParallelism
    qb = max(1, math.ceil(n_q / query_block_rows), math.ceil(min_tasks / total_rb))
    qb = min(qb, max(1, n_q))
    bmap = _literal_map(blocks)
    groups = F.array(*[F.lit(str(g)) for g in blocks]) if blocks else F.array().cast("array<string>")

    rq = (q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(qb)).cast("int"))
          .withColumn("_g", F.explode(groups)))
    if exclude_same_group:
        rq = rq.filter(F.col("_qg").isNull() | (F.col("_qg") != F.col("_g")))
    rq = rq.withColumn("_rb", F.explode(F.sequence(F.lit(0), F.element_at(bmap, F.col("_g")).cast("int") - 1)))
    rr = (r.withColumn("_rb", F.pmod(F.xxhash64("_rid"), F.element_at(bmap, F.col("_g"))).cast("int"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
    return rq, rr


def _candidates(queries, refs, keep, *, kernel, schema, bound, normalise, zero_policy, metric, exclude_same_group,
                ref_block_rows, query_block_rows, one_block=None, **columns):
    """(kernel rows with the nearest of every query, rows per group, vector length, blocks of the largest group, whether
    every row is ``one_block``'s, the kernel for groups of one block each, which then replaces ``kernel``).

    Where some group has several blocks, pivots leave out those that cannot hold a neighbour
    (``densel.operators.pruned``); with one block to a group there is nothing to leave out.
    """
    q, r, counts, dim, blocks, n_q = _blocked_inputs(
        queries, refs, exclude_same_group=exclude_same_group, ref_block_rows=ref_block_rows,
        query_block_rows=query_block_rows, grow_refs=one_block is not None, **columns)
    if max(blocks.values(), default=1) > 1 and dim > 0 and n_q > 0:
        prepare = functools.partial(_normalise, zero_policy=zero_policy) if normalise else _as_is
        cands, n_blocks, _ = pruned_candidates(
            q, r, counts, dim, keep, metric=metric, exclude=exclude_same_group, block_rows=ref_block_rows,
            query_rows=query_block_rows, kernel=kernel, schema=schema, bound=bound, prepare=prepare)
        return cands, counts, dim, n_blocks, False
    width = dim if one_block else max(dim, keep)
    rq, rr = _every_block(q, r, blocks, n_q, exclude_same_group, grown_rows(n_q, query_block_rows, width))
    keys = ["_g", "_qb", "_rb"]
    cands = (rq.select("_qid", "_qg", "_qv", *keys).groupBy(*keys)
             .cogroup(rr.select("_rid", "_rv", *keys).groupBy(*keys)).applyInArrow(one_block or kernel, schema))
    return cands, counts, dim, 1, one_block is not None


def _as_is(m: np.ndarray) -> np.ndarray:
    return m


def ref_block_rows_for(k: int, base: int = DEFAULT_REF_BLOCK_ROWS) -> int:
    """Reference block size for a k: at least 8·(k+1) rows, so each block hands at most an eighth
    of its rows to the merge (the merge holds (k+1) distances per query and reference block)."""
    return int(max(base, 8 * (int(k) + 1)))


def knn_nearest_distances(queries: DataFrame, refs: DataFrame, k: int, *, query_id: str = "id",
                          query_vec: str = "v", query_group: str | None = None, ref_id: str = "id",
                          ref_vec: str = "v", ref_group: str | None = None, exclude_same_group: bool = False,
                          normalise: bool = True, zero_policy: str = "keep", metric: str = "l2",
                          ref_block_rows: int | None = None,
                          query_block_rows: int = DEFAULT_QUERY_BLOCK_ROWS) -> DataFrame:
    """Sorted nearest distances per (query, reference group): positions 0..k (k+1 values, fewer if n<k+1).

    Returns ``(qid, qgroup, ref_group, n_ref, near array<double>)``; ``near`` is ascending squared
    L2 (or descending inner product for ``metric='ip'``). Without ``ref_group`` all references form
    one group named ``__all__``; references with a null group belong to none. A vector with a
    non-finite component, and with ``zero_policy='nan'`` a zero vector, has distance NaN to all: such
    references come after all others, such queries have NaN throughout.
    """
    return _nearest(queries, refs, k, query_id=query_id, query_vec=query_vec, query_group=query_group,
                    ref_id=ref_id, ref_vec=ref_vec, ref_group=ref_group, exclude_same_group=exclude_same_group,
                    normalise=normalise, zero_policy=zero_policy, metric=metric, ref_block_rows=ref_block_rows,
                    query_block_rows=query_block_rows)[0]


def _nearest(queries, refs, k, *, query_id, query_vec, query_group, ref_id, ref_vec, ref_group,
             exclude_same_group, normalise, zero_policy, metric, ref_block_rows, query_block_rows, positions=None):
    """knn_nearest_distances plus the vector dimension found while planning the blocks, and whether ``near`` holds only
    the ``positions`` min(k, n−1) asked for (so where every group is one block, and no block size is asked for)."""
    keep = int(k) + 1
    one_block = _make_position_kernel(positions, normalise, zero_policy) if positions and not ref_block_rows else None
    ref_block_rows = ref_block_rows or ref_block_rows_for(k)
    query_block_rows = query_rows_for(k, query_block_rows)
    score = F.element_at("_near", keep)   # of ascending scores: squared L2 or negated inner product
    blocks, counts, dim, n_blocks, picked = _candidates(
        queries, refs, keep, one_block=one_block, kernel=_make_kth_kernel(keep, normalise, zero_policy, metric),
        schema="_qid bigint, _qg string, _g string, _rb bigint, _near array<double>",
        bound=lambda rows: rows.filter(F.size("_near") >= keep).select(
            "_qid", "_g", (score if metric == "ip" else F.sqrt(score)).alias("_bound")),
        normalise=normalise, zero_policy=zero_policy, metric=metric, exclude_same_group=exclude_same_group,
        ref_block_rows=ref_block_rows, query_block_rows=query_block_rows, query_id=query_id, query_vec=query_vec,
        query_group=query_group, ref_id=ref_id, ref_vec=ref_vec, ref_group=ref_group)

    def best(col):
        return F.slice(F.sort_array(col), 1, keep)   # NaN sorts last; no nulls

    # hierarchical merge: while more than MERGE_FANOUT reference blocks remain, merge groups of
    # MERGE_FANOUT blocks and keep the best k+1, so no merge group grows with the data
    while n_blocks > MERGE_FANOUT:
        blocks = (blocks.withColumn("_rb", F.floor(F.col("_rb") / MERGE_FANOUT).cast("bigint"))
                  .groupBy("_qid", "_qg", "_g", "_rb")
                  .agg(best(F.flatten(F.collect_list("_near"))).alias("_near")))
        n_blocks = math.ceil(n_blocks / MERGE_FANOUT)
    if picked:
        merged, near = blocks, F.col("_near")   # one row for each query and group
    else:
        merged = (blocks.groupBy("_qid", "_qg", "_g")
                  .agg(F.flatten(F.collect_list("_near")).alias("_all")))
        near = best(F.col("_all"))
    if metric == "ip":
        near = F.transform(near, lambda x: -x)
    out = merged.select(F.col("_qid").alias("qid"), F.col("_qg").alias("qgroup"),
                        F.col("_g").alias("ref_group"),
                        F.element_at(_literal_map(counts), F.col("_g")).alias("n_ref"), near.alias("near"))
    return out, dim, picked


def knn_topk(queries: DataFrame, refs: DataFrame, k: int, *, query_id: str = "id", query_vec: str = "v",
             query_group: str | None = None, ref_id: str = "id", ref_vec: str = "v",
             ref_group: str | None = None, exclude_same_group: bool = False, normalise: bool = True,
             zero_policy: str = "keep", metric: str = "l2",
             ref_block_rows: int | None = None,
             query_block_rows: int = DEFAULT_QUERY_BLOCK_ROWS) -> DataFrame:
    """C1 + E4: the exact k nearest references per query (and reference group) as rows.

    Output ``(qid, ref_group, rank, rid, distance)``; rank is 0-based, ordered by squared L2
    ascending (inner product descending for ``metric='ip'``) and then by ``rid``.
    """
    keep = int(k)
    ref_block_rows = ref_block_rows or ref_block_rows_for(k)
    query_block_rows = query_rows_for(k, query_block_rows)
    score = F.max(F.when(F.lit(metric == "ip"), -F.col("_d")).otherwise(F.sqrt("_d")))
    cands, counts, _, n_blocks, _ = _candidates(
        queries, refs, keep, kernel=_make_topk_kernel(keep, normalise, zero_policy, metric),
        schema="_qid bigint, _g string, _rb bigint, _rid bigint, _d double",
        bound=lambda rows: rows.groupBy("_qid", "_g", "_rb").agg(F.count(F.lit(1)).alias("_n"), score.alias("_bound"))
        .filter(F.col("_n") >= keep).select("_qid", "_g", "_bound"),
        normalise=normalise, zero_policy=zero_policy, metric=metric, exclude_same_group=exclude_same_group,
        ref_block_rows=ref_block_rows, query_block_rows=query_block_rows, query_id=query_id, query_vec=query_vec,
        query_group=query_group, ref_id=ref_id, ref_vec=ref_vec, ref_group=ref_group)
    order = [F.isnan("_d"), F.col("_d").desc() if metric == "ip" else F.col("_d").asc(), F.col("_rid").asc()]
    # hierarchical cut: window partitions never hold more than MERGE_FANOUT blocks' candidates
    while n_blocks > MERGE_FANOUT:
        cands = cands.withColumn("_rb", F.floor(F.col("_rb") / MERGE_FANOUT).cast("bigint"))
        wl = Window.partitionBy("_qid", "_g", "_rb").orderBy(*order)
        cands = cands.withColumn("_rn", F.row_number().over(wl)).filter(F.col("_rn") <= keep).drop("_rn")
        n_blocks = math.ceil(n_blocks / MERGE_FANOUT)
    w = Window.partitionBy("_qid", "_g").orderBy(*order)
    return (cands.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= keep)
            .select(F.col("_qid").alias("qid"), F.col("_g").alias("ref_group"),
                    (F.col("_rn") - 1).cast("bigint").alias("rank"),
                    F.col("_rid").alias("rid"), F.col("_d").alias("distance")))


def attach_neighbour_text(neighbours: DataFrame, refs: DataFrame, ref_id: str = "id",
                          columns: Sequence[str] = ("text",)) -> DataFrame:
    """Resolve neighbour ids to reference attributes (equi-join on the id)."""
    side = refs.select(F.col(ref_id).cast("bigint").alias("rid"), *columns)
    return neighbours.join(side, "rid", "left")


# ------------------------------------------------------------------ density
def vector_dimension(df: DataFrame, vec: str) -> int:
    """The common length of a vector column; raises if rows differ (A4 dimension check)."""
    row = df.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if row is None or row["lo"] is None:
        raise ValueError("empty vector column")
    if row["lo"] != row["hi"]:
        raise ValueError(f"vector lengths differ: {row['lo']}..{row['hi']}")
    return int(row["lo"])


def density_from_near(near: DataFrame, ks: Sequence[int], d: int, *, radius: str = "squared",
                      dim_mode: str = "vector", picked: bool = False) -> DataFrame:
    """D1 formula over a ``near`` table: one row per input row and k (``picked``: ``near`` holds near[k'] of each k only).

    k' = min(k, n−1); r = max(near[k'], 1e-10) (``radius='euclidean'`` takes the square root first);
    log_volume = (D/2)·ln π + D·ln r − ln Γ(D/2+1) with D = d (or n for ``dim_mode='n_ref'``);
    log_density = ln k' − ln n − log_volume, −∞ when k' = 0.
    """
    kcol = F.posexplode(F.array(*[F.lit(int(k)) for k in ks])).alias("_at", "k")
    t = near.select("*", kcol)
    kp = F.least(F.col("k"), F.col("n_ref") - 1)
    kth = F.element_at(F.col("near"), ((F.col("_at") if picked else kp) + 1).cast("int"))
    if radius == "euclidean":
        kth = F.sqrt(kth)
    elif radius != "squared":
        raise ValueError(f"unknown radius {radius!r}")
    r = F.greatest(kth, F.lit(EPSILON))
    if dim_mode == "vector":
        dd = F.lit(float(d))
        lg = F.lit(log_gamma_half_plus_one(d))
    elif dim_mode == "n_ref":
        dd = F.col("n_ref").cast("double")
        # ln Γ(n/2+1) per group; only one value per distinct n, computed on the driver
        ns = [row[0] for row in near.select("n_ref").distinct().collect()]
        lg = F.element_at(F.create_map(*sum(([F.lit(int(n)), F.lit(log_gamma_half_plus_one(int(n)))] for n in ns), [])),
                          F.col("n_ref")) if ns else F.lit(0.0)
    else:
        raise ValueError(f"unknown dim_mode {dim_mode!r}")
    logvol = dd / 2.0 * F.lit(math.log(math.pi)) + dd * F.ln(r) - lg
    lnk = F.when(kp <= 0, F.lit(float("-inf"))).otherwise(F.ln(kp.cast("double")))
    dens = lnk - F.ln(F.col("n_ref").cast("double")) - logvol
    return t.select("qid", "qgroup", "ref_group", F.col("k").cast("bigint").alias("k"),
                    F.col("n_ref").cast("bigint").alias("n_ref"), kp.cast("bigint").alias("k_used"),
                    kth.alias("kth_distance"), logvol.alias("log_volume"), dens.alias("log_density"))


def knn_log_density(queries: DataFrame, refs: DataFrame, k: int, *, query_id: str = "id", query_vec: str = "v",
                    ref_id: str = "id", ref_vec: str = "v", normalise: bool = True, zero_policy: str = "keep",
                    radius: str = "squared", dim_mode: str = "vector", **block_kw) -> DataFrame:
    """D1 (flagship): kNN log-density of each query row under one reference set.

    Returns ``(qid, k, n_ref, k_used, kth_distance, log_volume, log_density)``.
    """
    near, d, picked = _nearest(queries, refs, k, positions=[int(k)], query_id=query_id, query_vec=query_vec, query_group=None,
                       ref_id=ref_id, ref_vec=ref_vec, ref_group=None, exclude_same_group=False,
                       normalise=normalise, zero_policy=zero_policy, metric="l2",
                       ref_block_rows=block_kw.get("ref_block_rows"),
                       query_block_rows=block_kw.get("query_block_rows", DEFAULT_QUERY_BLOCK_ROWS))
    return (density_from_near(near, [k], d, radius=radius, dim_mode=dim_mode, picked=picked)
            .drop("qgroup", "ref_group"))


def knn_log_density_all(vecs: DataFrame, ks: Sequence[int], *, queries: DataFrame | None = None,
                        id_col: str = "id", vec: str = "v", group: str = "term", include_same_group: bool = False, normalise: bool = True,
                        zero_policy: str = "keep", radius: str = "squared", dim_mode: str = "vector",
                        **block_kw) -> DataFrame:
    """Log-density of every row under every *other* group, for each k in ``ks``, in one pass.

    One blocked join keyed by reference group serves all (row, group) pairs and every k:
    the merged array holds positions 0..max(ks), and each k reads its own position. ``queries``
    restricts the rows that are asked for (all rows by default).
    Returns ``(qid, source_term, target_term, k, n_ref, k_used, kth_distance, log_volume, log_density)``.
    """
    near, d, picked = _nearest(vecs if queries is None else queries, vecs, max(ks), positions=[int(k) for k in ks], query_id=id_col, query_vec=vec, query_group=group,
                       ref_id=id_col, ref_vec=vec, ref_group=group, exclude_same_group=not include_same_group,
                       normalise=normalise, zero_policy=zero_policy, metric="l2",
                       ref_block_rows=block_kw.get("ref_block_rows"),
                       query_block_rows=block_kw.get("query_block_rows", DEFAULT_QUERY_BLOCK_ROWS))
    return (density_from_near(near, ks, d, radius=radius, dim_mode=dim_mode, picked=picked)
            .withColumnRenamed("qgroup", "source_term").withColumnRenamed("ref_group", "target_term"))


# ------------------------------------------------------------------ similarity checks
def distribution_similarity(a: DataFrame, b: DataFrame, method: str = "nn", *, id_col: str = "id",
                            vec: str = "v", **block_kw) -> DataFrame:
    """One-row similarity of B to A.

    ``nn``: mean over B of the squared L2 distance to its nearest A, raw vectors (no normalisation);
    ``cosine``: mean over B of the largest cosine similarity to A (both sides normalised).
    """
    if method == "nn":
        near = knn_nearest_distances(b, a, 0, query_id=id_col, query_vec=vec, ref_id=id_col, ref_vec=vec,
                                     normalise=False, **block_kw)
    elif method == "cosine":
        near = knn_nearest_distances(b, a, 0, query_id=id_col, query_vec=vec, ref_id=id_col, ref_vec=vec,
                                     normalise=True, metric="ip", **block_kw)
    else:
        raise ValueError(f"unknown method {method!r}")
    return near.agg(F.avg(F.element_at("near", 1)).alias("similarity"), F.count("*").alias("n_b"))


def selection_improves_similarity(a: DataFrame, b: DataFrame, selected: DataFrame, *, id_col: str = "id",
                                  vec: str = "v", **block_kw) -> DataFrame:
    """D8 for (A, selected B) and (A, all B); lower distance is better."""
    # the selected rows are a subset of B, so one search of all of B serves both means
    near = knn_nearest_distances(b, a, 0, query_id=id_col, query_vec=vec, ref_id=id_col, ref_vec=vec,
                                 normalise=False, **block_kw)
    chosen = selected.select(F.col(id_col).cast("bigint").alias("qid"), F.lit(True).alias("_sel")).distinct()
    t = near.join(chosen, "qid", "left").select(F.element_at("near", 1).alias("_d"), "_sel")
    agg = t.agg(F.avg("_d").alias("similarity_all"),
                F.avg(F.when(F.col("_sel"), F.col("_d"))).alias("similarity_selected"))
    return agg.select("similarity_all", "similarity_selected",
                      (F.col("similarity_selected") < F.col("similarity_all")).alias("improves"))
