"""Pivot pruning for the exact kNN joins: a query meets only the reference cells that can hold a neighbour.

References of a group with several blocks are dealt to the cells of pivots (each to the nearest one); a cell
knows its row count and radius. A query first meets its home cell, which gives an upper bound of its kth
distance. By the triangle inequality a cell whose pivot is further than that bound plus the radius holds
no neighbour, so in a second pass the query meets only the other cells. Cells larger than a block
are split; blocks grow with their group, so that a vector travels a bounded number of times until blocks are as large as
memory allows (``grown_rows``); references travel only to the query blocks that ask for their cell. Pivots are few and of bounded number,
so their matrix is broadcast; they decide costs, never results: bounds are widened by the rounding error of
their computation, and the kernels compute the distances of all pairs that meet.

References with a non-finite component lie in a cell of their own (``BAD``), read where finite ones
cannot fill all places; queries with one meet all cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.operators.ranking import join_small
from densel.session import materialise

MAX_PIVOTS = 16_384        # pivots of all groups: at 384 doubles 50 MB, broadcast
MAX_BLOCKS = 16            # blocks of a group, and query blocks that meet one, before they grow (up to BLOCK_VALUES)
BLOCK_VALUES = 16_384 * 384  # components of a grown block: 50 MB as doubles
SAMPLE_PER_PIVOT = 4       # rows sampled (by a hash of the id) for each pivot that is chosen
BAD = -1                   # cell of references without distances
_U64 = float(np.finfo(np.float64).eps) / 2


def grown_rows(n: int, rows: int, width: int) -> int:
    """Rows of a block where ``n`` rows would make more than ``MAX_BLOCKS`` blocks of ``rows``: as many as leave that number.

    A vector travels once to each block it meets, so with blocks of a fixed size the rows shuffled grow with the square of
    the input. A grown block holds at most ``BLOCK_VALUES`` numbers, ``width`` to a row; ``rows`` is never made smaller.
    """
    return max(rows, min(math.ceil(n / MAX_BLOCKS), BLOCK_VALUES // max(1, width)))


def pivot_numbers(counts: dict, block_rows: int | dict, limit: int = MAX_PIVOTS) -> dict:
    """Pivots for each group: one for each block of rows, scaled down together where all would pass the limit."""
    want = {g: math.ceil(n / (block_rows[g] if isinstance(block_rows, dict) else block_rows)) for g, n in counts.items()}
    total = sum(want.values())
    if total <= limit:
        return want
    return {g: max(1, math.floor(w * limit / total)) for g, w in want.items()}


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows (fewer if there are fewer different ones), each the farthest from those before it."""
    if not len(rows):
        return rows
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < n:
        i = int(gap.argmax())
        if gap[i] <= 0:
            break
        chosen.append(i)
        gap = np.minimum(gap, ((rows - rows[i]) ** 2).sum(axis=1))
    return rows[chosen]


def choose_pivots(refs: DataFrame, counts: dict, numbers: dict, prepare: Callable, dim: int) -> dict:
    """{group: pivot matrix} from a sample of bounded size: rows whose id hashes below a share of their group's rows."""
    share = {g: min(1.0, 2 * SAMPLE_PER_PIVOT * numbers[g] / n + 16 / n) for g, n in counts.items()}
    spark = refs.sparkSession
    table = spark.createDataFrame([(g, float(s)) for g, s in share.items()], "_g string, _share double")
    draw = (F.pmod(F.xxhash64("_rid", F.lit("pivot")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows = (join_small(refs, table, "_g", known_rows=len(share)).filter(draw < F.col("_share")).select("_g", "_rid", "_rv").toArrow())
    groups = np.array(rows.column("_g").to_pylist(), dtype=object)
    order = np.argsort(rows.column("_rid").to_numpy(), kind="stable")
    m = _vectors(rows, "_rv", dim, prepare)
    out = {}
    for g, n in numbers.items():
        mine = m[order][groups[order] == g]
        mine = mine[np.isfinite(mine).all(axis=1)]
        out[g] = farthest_first(mine, n)
    return out


def _vectors(rows, col: str, dim: int, prepare: Callable) -> np.ndarray:
    c = rows.column(col)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return prepare(flat.reshape(len(c), dim)) if len(c) else np.zeros((0, dim))


def _distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots and, per row, the most that rounding can have changed one."""
    xx, pp = (x * x).sum(axis=1), (pivots * pivots).sum(axis=1)
    d = np.sqrt(np.maximum(xx[:, None] + pp[None, :] - 2.0 * (x @ pivots.T), 0.0))
    return d, np.sqrt(8.0 * (x.shape[1] + 2) * _U64 * (xx + pp.max(initial=0.0)))


def _assign(told, dim: int, prepare: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = told.value
        for batch in batches:
            x = _vectors(batch, 2, dim, prepare)
            groups = np.array(batch.column(1).to_pylist(), dtype=object)
            good = np.isfinite(x).all(axis=1)
            cell, reach = np.full(len(x), BAD, np.int64), np.zeros(len(x))
            for g in set(groups[good].tolist()):
                at = np.flatnonzero(good & (groups == g))
                for s in range(0, len(at), 2048):
                    part = at[s:s + 2048]
                    d, margin = _distances(x[part], pivots[g])
                    cell[part] = d.argmin(axis=1)
                    reach[part] = d.min(axis=1) + margin
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell), pa.array(reach)],
                                             names=["_rid", "_g", "_rv", "_cell", "_reach"])
    return run


class Cells:
    """The cells of all groups: rows, radius and blocks of each, and the number of each cell's first block."""

    def __init__(self, pivots: dict, stats: list, block_rows: dict):
        self.pivots, self.rows, self.radius, self.first = pivots, {}, {}, {}
        found = {(r["_g"], r["_cell"]): (int(r["n"]), float(r["radius"])) for r in stats}
        for g, p in pivots.items():
            cells = [*range(len(p)), BAD]
            n = np.array([found.get((g, c), (0, 0.0))[0] for c in cells])
            self.rows[g] = n[:-1]
            self.radius[g] = np.array([found.get((g, c), (0, 0.0))[1] for c in cells[:-1]])
            blocks = -(-n // block_rows[g])
            start = np.cumsum(blocks) - blocks
            self.first[g] = {c: (int(start[i]), int(blocks[i])) for i, c in enumerate(cells) if n[i]}
        self.n_blocks = max((sum(b for _, b in f.values()) for f in self.first.values()), default=1)

    def bounds(self, g: str, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a reference of each cell may have with each query (squared off for L2: distances)."""
        p, r = self.pivots[g], self.radius[g]
        if metric == "ip":
            size = np.sqrt((x * x).sum(axis=1))
            margin = 8.0 * (x.shape[1] + 2) * _U64 * size * np.sqrt((p * p).sum(axis=1).max(initial=0.0)) + 1e-300
            mid, spread = -(x @ p.T), size[:, None] * r[None, :] * (1 + 1e-12) + margin[:, None]
        else:
            mid, margin = _distances(x, p)
            spread = r[None, :] * (1 + 1e-12) + margin[:, None]
        return mid - spread, mid + spread


def _home(told, dim: int, keep: int, metric: str, exclude: bool, prepare: Callable) -> Callable:
    """(qid, g, cell, cap): the first cells that each query meets, with the bound that cell counts alone give."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = told.value
        for batch in batches:
            x = _vectors(batch, 2, dim, prepare)
            good = np.isfinite(x).all(axis=1)
            own = np.array(batch.column(1).to_pylist(), dtype=object)
            qid = batch.column(0).to_numpy()
            for g in cells.pivots:
                here = (own != g) if exclude else np.ones(len(x), bool)
                ids, cs, caps = [], [], []
                n, at = cells.rows[g], np.flatnonzero(good & here)
                some = np.flatnonzero(n)
                if len(some):
                    for s in range(0, len(at), 2048):
                        part = at[s:s + 2048]
                        low, high = cells.bounds(g, x[part], metric)
                        home = some[high[:, some].argmin(axis=1)]
                        cap = np.full(len(part), np.inf)
                        if n[some].sum() >= keep:
                            order = some[np.argsort(high[:, some], axis=1)]
                            enough = np.cumsum(n[order], axis=1) >= keep
                            cap = np.take_along_axis(high, order, 1)[np.arange(len(part)), enough.argmax(axis=1)]
                        ids.append(qid[part])
                        cs.append(home)
                        caps.append(cap)
                else:
                    ids.append(qid[at])  # no reference has distances: the cell of the others
                    cs.append(np.full(len(at), BAD))
                    caps.append(np.full(len(at), np.inf))
                odd = np.flatnonzero(~good & here)
                for c in cells.first[g]:
                    ids.append(qid[odd])
                    cs.append(np.full(len(odd), c))
                    caps.append(np.full(len(odd), -np.inf))  # all cells at once: nothing is left for the second pass
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids), pa.int64()), pa.array([g] * sum(map(len, ids)), pa.string()),
                     pa.array(np.concatenate(cs).astype(np.int64)), pa.array(np.concatenate(caps).astype(np.float64))],
                    names=["_qid", "_g", "_cell", "_cap"])
    return run


def _others(told, dim: int, keep: int, metric: str, prepare: Callable) -> Callable:
    """(qid, g, cell): the cells besides the first that may hold a neighbour nearer than the query's bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = told.value
        for batch in batches:
            x = _vectors(batch, 1, dim, prepare)
            qid, asked = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            by_group: dict[str, list[tuple[int, int, float]]] = {}
            for i, places in enumerate(asked):
                for a in places:
                    by_group.setdefault(a["_g"], []).append((i, a["_cell"], a["_bound"]))
            for g, places in by_group.items():
                n = cells.rows[g]
                for s in range(0, len(places), 2048):
                    part = places[s:s + 2048]
                    row = np.array([p[0] for p in part])
                    home, bound = np.array([p[1] for p in part]), np.array([p[2] for p in part])
                    if not len(n):
                        continue
                    low, _ = cells.bounds(g, x[row], metric)
                    visit = (low <= bound[:, None]) & (n > 0)[None, :]
                    at = np.flatnonzero(home >= 0)
                    visit[at, home[at]] = False
                    i, c = np.nonzero(visit)
                    if n.sum() < keep and BAD in cells.first[g]:
                        i, c = np.append(i, at), np.append(c, np.full(len(at), BAD))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row[i]], pa.int64()), pa.array([g] * len(i), pa.string()),
                                                      pa.array(c.astype(np.int64))], names=["_qid", "_g", "_cell"])
    return run


def _meet(visits: DataFrame, queries: DataFrame, refs: DataFrame, cells: Cells, query_rows: int, width: int, kernel: Callable, schema: str) -> DataFrame:
    """The kernel's rows over (query block, reference block) pairs of the visited cells only."""
    spark = visits.sparkSession
    asked = {(r["_g"], r["_cell"]): int(r["n"]) for r in visits.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [(g, c, *cells.first[g][c], max(1, -(-n // grown_rows(n, query_rows, width)))) for (g, c), n in asked.items()]  # one row for each cell
    table = spark.createDataFrame(plan, "_g string, _cell bigint, _first bigint, _blocks bigint, _qbs bigint")
    block = lambda: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    left = (join_small(visits.select("_qid", "_g", "_cell"), table, ["_g", "_cell"], known_rows=len(plan))
            .withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_qbs"))).withColumn("_b", block())
            .select("_qid", "_g", "_qb", (F.col("_first") + F.col("_b")).alias("_rb")).join(queries, "_qid"))
    right = (join_small(refs, table, ["_g", "_cell"], known_rows=len(plan))
             .withColumn("_rb", F.col("_first") + F.pmod(F.xxhash64("_rid"), F.col("_blocks")))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_qbs") - 1)))
             .select("_rid", "_rv", "_g", "_qb", "_rb"))
    keys = ["_g", "_qb", "_rb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def pruned_candidates(queries: DataFrame, refs: DataFrame, counts: dict, dim: int, keep: int, *, metric: str, exclude: bool,
                      block_rows: int, query_rows: int, kernel: Callable, schema: str, bound: Callable, prepare: Callable,
                      pivot_limit: int = MAX_PIVOTS) -> tuple[DataFrame, int, DataFrame]:
    """(candidates, blocks of the largest group, cells visited in the second pass).

    ``queries`` (_qid unique, _qg, _qv) and ``refs`` (_rid, _g, _rv) hold vectors of ``dim`` components; ``bound`` turns the
    kernel's rows into (_qid, _g, _bound), the kth score of each block that has one. The candidates are the
    kernel's rows of all pairs of blocks that met, which include the ``keep`` nearest of every query and group.
    """
    spark = queries.sparkSession
    sc = spark.sparkContext
    width = max(dim, keep)   # numbers held for a row: its components or its scores
    rows_of = {g: grown_rows(n, block_rows, width) for g, n in counts.items()}
    pivots = choose_pivots(refs, counts, pivot_numbers(counts, rows_of, pivot_limit), prepare, dim)
    for g, p in pivots.items():
        if not len(p):  # the sample had no finite vector: one pivot at the origin serves any that there are
            pivots[g] = np.zeros((1, dim))
    types = dict(refs.dtypes)
    placed = materialise(refs.select("_rid", "_g", "_rv").mapInArrow(
        _assign(sc.broadcast(pivots), dim, prepare), f"_rid bigint, _g string, _rv {types['_rv']}, _cell bigint, _reach double"))
    stats = placed.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_reach").alias("radius")).collect()  # as many as pivots
    cells = Cells(pivots, stats, rows_of)
    told = sc.broadcast(cells)
    home = materialise(queries.select("_qid", "_qg", "_qv").mapInArrow(
        _home(told, dim, keep, metric, exclude, prepare), "_qid bigint, _g string, _cell bigint, _cap double"))
    first = materialise(_meet(home, queries, placed, cells, query_rows, width, kernel, schema))
    kth = bound(first).groupBy("_qid", "_g").agg(F.min("_bound").alias("_kth"))
    slack = 1 + 1e-12
    limit = F.least(F.col("_cap"), F.coalesce(F.nanvl("_kth", F.lit(math.inf)), F.lit(math.inf)) * slack if metric != "ip"
                    else F.coalesce(F.nanvl("_kth", F.lit(math.inf)), F.lit(math.inf)) + F.abs(F.coalesce("_kth", F.lit(0.0))) * 1e-12)
    asked = (home.filter(F.col("_cap") > -math.inf).join(kth, ["_qid", "_g"], "left")
             .groupBy("_qid").agg(F.collect_list(F.struct("_g", "_cell", limit.alias("_bound"))).alias("_asked")))
    rest = materialise(queries.select("_qid", "_qv").join(asked, "_qid").mapInArrow(
        _others(told, dim, keep, metric, prepare), "_qid bigint, _g string, _cell bigint"))
    second = _meet(rest, queries, placed, cells, query_rows, width, kernel, schema)
    return first.unionByName(second), cells.n_blocks, rest
