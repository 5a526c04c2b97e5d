"""Near-duplicate vectors by robust-pruned flat graphs on overlapping cluster shards.

Vectors of a label are dealt to shards around sampled cluster centres, each to its nearest few. Every
shard builds a flat graph: greedy searches find each point's neighbourhood, and robust pruning keeps
neighbours in all directions. A point's adjacency lists of all its shards are united. Each point is then
searched in its shards from the medoid; the search goes on from all points in range until no new one is
met. Pairs found are verified in double precision. Dense shards that cannot be split, and labels whose
recall the audit against brute force does not show to be enough, are compared block by block instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densel.llm.components import connected_components
from densel.llm.tables import written

#: Members from which a shard is split around centres of its own.
SHARD = 800
#: Sampled members of a shard that choose its centres, and the most centres of one split.
SAMPLE, CENTRES = 2_000, 64
DEGREE, BEAM, ALPHA = 24, 40, 1.2
#: A vector joins further shards only if their centres are at most this much farther than its nearest (unit vectors
#: of cosine 0.98 are 0.2 apart, so their distances to a centre differ by 0.2 and those to two by 0.4 at most); shards
#: still large after so many splits, or that a split leaves with most of their members, stay whole.
SLACK, LEVELS, SHRINK = 0.4, 8, 0.9
#: Shards a vector is dealt to at each split; labels that the audit does not pass go on to the next, then to brute force.
OVERLAPS = (2, 4)
#: Classes audited, spread over the labels; vectors with true links that a label's recall (their mean) needs.
AUDIT_QUERIES, AUDIT_RECALL, AUDIT_LINKED = 2_000, 0.95, 20
#: Members of a block of a shard that is compared block by block.
BLOCK = 4_000

MEMBER = "shard string, rep long, n long, vector binary"
_MEMBER = pa.schema([("shard", pa.string()), ("rep", pa.int64()), ("n", pa.int64()), ("vector", pa.binary())])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), np.float64) for x in column])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes of equal vectors with equal labels, membership (vec_id, rep)); invalid vectors are in neither.

    A vector counts if its label is not null and it has components, all finite, not all zero.
    ``rep`` is the class's smallest vec_id, ``n`` its size. Vectors of different length are never compared.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(ok).select("vec_id", F.col("label").cast("string").alias("label"),
                                     F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    reps = written(rows.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                                       F.first("v").alias("v")), "vector-classes")
    members = rows.select("vec_id", "label", "digest").join(reps.select("label", "digest", "rep"), ["label", "digest"])
    return reps, members.select("vec_id", "rep")


def _centres(group: pa.Table) -> pa.Table:
    """Centres of a sampled shard: a few rounds of spherical k-means, centres closer than near-duplicates merged."""
    x = _unit(_matrix(group.column("vector")))
    n = int(group.column("size")[0].as_py())
    k = min(CENTRES, max(2, -(-3 * n // SHARD)), len(x))
    centres = x[np.random.default_rng(len(x)).permutation(len(x))[:k]]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), centres)
    kept: list[int] = []
    for i in range(len(centres)):  # 0.9: a ball of near-duplicates is not cut apart
        if not kept or (centres[kept] @ centres[i]).max() < 0.9:
            kept.append(i)
    return pa.table({"shard": [group.column("shard")[0].as_py()], "centres": [centres[kept].astype(np.float32).tobytes()]})


def _deal(overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members to their nearest centres; a shard that could not be split keeps its members and is closed."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in _MEMBER.names}
        shards = batch.column("shard").to_pylist()
        for shard in set(shards):
            rows = [i for i, s in enumerate(shards) if s == shard]
            part = batch.take(pa.array(rows))
            x = _unit(_matrix(part.column("vector")))
            c = np.frombuffer(part.column("centres")[0].as_py(), np.float32).reshape(-1, x.shape[1])
            k = min(overlap, len(c))
            sims = x @ c.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if len(c) > 1 else np.zeros((len(x), 1), int)
            away = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, axis=1), 0))
            close = away <= away.min(axis=1, keepdims=True) + SLACK
            whole = len(c) == 1 or shard.count("/") >= LEVELS
            for j in range(near.shape[1]):
                mine = np.flatnonzero(close[:, j])
                if whole:
                    mine = np.arange(len(x)) if j == 0 else mine[:0]
                out["shard"] += [f"{shard}!" if whole else f"{shard}/{m}" for m in near[mine, j]]
                for name in ("rep", "n", "vector"):
                    out[name] += part.column(name).take(pa.array(mine)).to_pylist()
        yield pa.RecordBatch.from_pydict(out, schema=_MEMBER)


def _pack():
    """Vectors are compared within a pack: of one label and length."""
    return F.concat_ws(":", "label", F.size("v"))


def _packed(rows: DataFrame) -> DataFrame:
    """Members (shard, rep, n, vector) of rows with shard, rep, n and v."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.array(x, np.float64).tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("rep"), b.column("n"), pa.array(v, pa.binary())],
                                             schema=_MEMBER)

    return rows.select("shard", "rep", "n", "v").mapInArrow(packed, MEMBER)


def shards(reps: DataFrame, overlap: int) -> DataFrame:
    """Members (shard, rep, n, vector) of the overlapping shards; shards over SHARD members are split until they fit.

    A shard whose sampled members all lie within near-duplicate distance of one centre is left whole, as is
    one that LEVELS splits did not bring below SHARD or a split did not shrink; its name ends in '!'.
    """
    open_, done = written(_packed(reps.withColumn("shard", _pack())), "shard-members"), []
    parents = None
    while True:
        if parents is not None:
            # a child with most of its parent's members is not split again
            counts = open_.filter(~F.col("shard").endswith("!")).groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
            counts = counts.withColumn("_parent", F.regexp_replace("shard", "/[0-9]+$", "")).join(parents, "_parent")
            stuck = counts.filter((F.col("_n") > SHARD) & (F.col("_n") > F.col("_of") * SHRINK)).select("shard", F.lit("!").alias("_end"))
            open_ = open_.join(stuck, "shard", "left").withColumn("shard", F.concat("shard", F.coalesce("_end", F.lit("")))).drop("_end")
            open_ = written(open_.select(*_MEMBER.names), "shard-members")
        sizes = written(open_.groupBy("shard").agg(F.count(F.lit(1)).alias("size")), "shard-sizes")
        large = sizes.filter((F.col("size") > SHARD) & ~F.col("shard").endswith("!"))
        if large.isEmpty():
            return _all([*done, open_])
        parents = large.select(F.col("shard").alias("_parent"), F.col("size").alias("_of"))
        done.append(open_.join(large, "shard", "left_anti"))
        rest = open_.join(large, "shard")
        sample = rest.filter(F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), (F.col("size") / SAMPLE).cast("long"))) == 0)
        centres = written(sample.groupBy("shard").applyInArrow(_centres, "shard string, centres binary"), "shard-centres")
        open_ = written(rest.drop("size").join(centres, "shard").select("shard", "rep", "n", "vector", "centres")
                        .mapInArrow(lambda it: _deal(overlap, it), MEMBER), "shard-members")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out, "shard-members")


def search(x: np.ndarray, adjacency: list[np.ndarray], queries: np.ndarray, start: int, beam: int,
           reach: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy graph search of many queries at once: (similarities to all met points, met). Unmet: -2.

    Each round expands the unexpanded points among a query's ``beam`` best, and with ``reach`` every
    unexpanded point at least that similar, until there are none: the beam grows with what is in range.
    """
    n, m = len(x), len(queries)
    sims = np.full((m, n), -2.0, dtype=np.float32)
    expanded = np.zeros((m, n), bool)
    sims[:, start] = queries @ x[start]
    width = np.array([len(a) for a in adjacency])
    flat = np.concatenate(adjacency) if width.sum() else np.zeros(0, np.int64)
    first = np.cumsum(width) - width
    active = np.arange(m)
    while len(active):
        s = sims[active]
        limit = np.partition(s, max(0, n - beam), axis=1)[:, max(0, n - beam)] if n > beam else np.full(len(s), -1.5)
        wanted = s >= np.maximum(limit, -1.5)[:, None]
        if reach is not None:
            wanted |= s >= reach
        wanted &= ~expanded[active]
        row, node = np.nonzero(wanted)
        if not len(row):
            break
        expanded[active[row], node] = True
        still = np.unique(row)
        for lo in range(0, len(row), 100_000):
            r, v = row[lo:lo + 100_000], node[lo:lo + 100_000]
            k = width[v]
            to = flat[np.repeat(first[v] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
            q = active[np.repeat(r, k)]
            new = sims[q, to] == -2.0
            code = np.unique(q[new] * n + to[new])
            q, to = code // n, code % n
            for part in range(0, len(q), 200_000):
                qs, ts = q[part:part + 200_000], to[part:part + 200_000]
                sims[qs, ts] = np.einsum("ij,ij->i", queries[qs], x[ts])
        active = active[still]
    return sims, sims > -2.0


def _pruned(x: np.ndarray, p: int, candidates: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Robust pruning: the nearest candidate stays, and removes those ALPHA times closer to it than to the point."""
    order = np.argsort(-sims, kind="stable")
    c = candidates[order]
    own = 2 - 2 * sims[order].astype(np.float64)  # squared distances
    between = 2 - 2 * (x[c] @ x[c].T)
    alive, kept = np.ones(len(c), bool), []
    alive[c == p] = False
    for i in range(len(c)):
        if alive[i]:
            kept.append(i)
            if len(kept) == DEGREE:
                break
            alive &= ALPHA * ALPHA * between[i] > own
            alive[i] = False
    return c[kept]


def flat_graph(x: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Adjacency lists of a flat graph over unit vectors, and the medoid."""
    n = len(x)
    rng = np.random.default_rng(n)
    medoid = int((x @ x.mean(axis=0)).argmax())
    graph = [np.unique(rng.integers(0, n, min(n, DEGREE // 2))) for _ in range(n)] if n > 1 else [np.zeros(0, np.int64)]
    graph = [a[a != i] for i, a in enumerate(graph)]
    order, batch = rng.permutation(n), max(1, min(256, 4_000_000 // max(1, n)))
    for lo in range(0, n, batch):
        points = order[lo:lo + batch]
        sims, met = search(x, graph, x[points], medoid, BEAM)
        back: dict[int, list[int]] = {}
        for row, p in enumerate(points.tolist()):
            c = np.flatnonzero(met[row])
            if len(c) > 4 * BEAM:
                c = c[np.argpartition(-sims[row, c], 4 * BEAM)[:4 * BEAM]]
            c = np.union1d(c, graph[p])
            c = c[c != p]
            graph[p] = _pruned(x, p, c, x[c] @ x[p]) if len(c) else c
            for q in graph[p].tolist():
                back.setdefault(q, []).append(p)
        for q, new in back.items():
            c = np.union1d(graph[q], np.array(new))
            graph[q] = c if len(c) <= DEGREE else _pruned(x, q, c, x[c] @ x[q])
    return graph, medoid


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("rep")
    reps = group.column("rep").to_numpy()
    graph, _ = flat_graph(_unit(_matrix(group.column("vector"))))
    return pa.table({"rep": pa.array(reps, pa.int64()),
                     "near": pa.array([reps[a].tolist() for a in graph], pa.list_(pa.int64()))})


FOUND = "rep long, root long, found array<struct<rep:long,n:long>>"
_FOUND = pa.schema([("rep", pa.int64()), ("root", pa.int64()),
                    ("found", pa.list_(pa.struct([("rep", pa.int64()), ("n", pa.int64())])))])


def _find(threshold: float, group: pa.Table) -> pa.Table:
    """For each member of a shard: verified links found in it, and the smallest member they connect it with."""
    group = group.sort_by("rep")
    reps, n_of = group.column("rep").to_numpy(), group.column("n").to_numpy()
    raw = _matrix(group.column("vector"))
    norm = np.linalg.norm(raw, axis=1)
    x, n = _unit(raw), len(raw)
    graph = []
    for near in group.column("near").to_pylist():
        near = np.array(near or [], np.int64)
        at = np.minimum(np.searchsorted(reps, near), n - 1)
        graph.append(at[reps[at] == near] if len(near) else np.zeros(0, np.int64))
    medoid = int((x @ x.mean(axis=0)).argmax())
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    ends, batch = [], max(1, min(256, 4_000_000 // n))
    for lo in range(0, n, batch):
        rows = np.arange(lo, min(n, lo + batch))
        sims, _ = search(x, graph, x[rows], medoid, BEAM, threshold - 0.01)
        for r in rows.tolist():
            c = np.flatnonzero(sims[r - lo] >= threshold - 1e-4)
            c = c[c != r]
            c = c[(raw[c] @ raw[r]) / (norm[c] * norm[r]) >= threshold] if len(c) else c
            ends.append(np.stack([np.full(len(c), r), c]))
            for j in c.tolist():
                a, b = top(r), top(j)
                root[max(a, b)] = min(a, b)
    # a link found from one end counts for both; those of two members of a dense shard are counted there
    a, b = np.concatenate(ends, axis=1)
    of, sets = _sets(group)
    apart = _owned(sets, sets, None)[of[a], of[b]]
    a, b = a[apart], b[apart]
    codes = np.unique(np.concatenate([a * n + b, b * n + a]))
    cuts = np.searchsorted(codes // n, np.arange(n + 1))
    found = [[{"rep": int(reps[j]), "n": int(n_of[j])} for j in codes[cuts[i]:cuts[i + 1]] % n] for i in range(n)]
    return pa.table([pa.array(reps, pa.int64()), pa.array([int(reps[top(i)]) for i in range(n)], pa.int64()),
                     pa.array(found, _FOUND.field("found").type)], schema=_FOUND)


def _sets(group: pa.Table) -> tuple[np.ndarray, list[frozenset]]:
    """Each member's number of its set of dense shards, and the sets."""
    ids: dict[frozenset, int] = {}
    of = [ids.setdefault(frozenset(x or ()), len(ids)) for x in group.column("dense").to_pylist()]
    return np.array(of, np.int64), list(ids)


def _owned(a: list[frozenset], b: list[frozenset], shard: str | None) -> np.ndarray:
    """Whether a shard counts the links of members of two sets of dense shards: the first that they share, None without."""
    return np.array([[min(x & y, default=None) == shard for y in b] for x in a], bool).reshape(len(a), len(b))


LINKS = "rep long, others long, root long"
_LINKS = pa.schema([("rep", pa.int64()), ("others", pa.int64()), ("root", pa.int64())])


def _parts(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the connected components of rows and columns that ``links`` joins; -1 without links."""
    rows, cols = np.full(links.shape[0], -1), np.full(links.shape[1], -1)
    for k, r in enumerate(np.flatnonzero(links.any(axis=1)).tolist()):
        if rows[r] >= 0:
            continue
        new = np.array([r])
        while len(new):
            rows[new] = k
            to = np.flatnonzero(links[new].any(axis=0) & (cols < 0))
            cols[to] = k
            new = np.flatnonzero(links[:, to].any(axis=1) & (rows < 0))
    return rows, cols


def _compare(threshold: float, group: pa.Table) -> pa.Table:
    """Links of two blocks of a dense shard: how many rows each member is linked to, and the smallest rep of its part."""
    mine, i, j = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    reps, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
    raw = _matrix(group.column("vector"))
    norm, (of, sets) = np.linalg.norm(raw, axis=1), _sets(group)
    a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    owned = _owned(sets, sets, group.column("shard")[0].as_py())
    links = np.zeros((len(a), len(b)), bool)
    others_a, others_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for lo in range(0, len(a), 500):
        r = a[lo:lo + 500]
        hit = (raw[r] @ raw[b].T) / (norm[r, None] * norm[b]) >= threshold
        hit &= reps[r, None] != reps[b]
        links[lo:lo + 500] = hit
        hit = hit & owned[of[r]][:, of[b]]
        others_a[lo:lo + 500] = hit @ n[b]
        others_b += n[r] @ hit
    parts, out = _parts(links), {}
    for at, part in zip((a, b), parts, strict=True):
        for rep, k in zip(reps[at].tolist(), part.tolist(), strict=True):
            if k >= 0:
                out[k] = min(out.get(k, rep), rep)
    # two blocks meet once, a block meets itself from both ends
    sides = [(a, others_a, parts[0])] + ([(b, others_b, parts[1])] if i != j else [])
    return pa.table([pa.array(np.concatenate([reps[at] for at, _, _ in sides]), pa.int64()),
                     pa.array(np.concatenate([others for _, others, _ in sides]), pa.int64()),
                     pa.array([out.get(k, rep) for at, _, part in sides
                               for k, rep in zip(part.tolist(), reps[at].tolist(), strict=True)], pa.int64())], schema=_LINKS)


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, others, root) by comparing all members of each shard, two blocks of about BLOCK a task.

    ``members`` has ``dense``, the shards compared in this way that a member is in. Pairs never leave a task.
    """
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_blocks"))
    rows = members.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), "_blocks").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("_blocks", "_other")
    return rows.groupBy("shard", "i", "j").applyInArrow(lambda g: _compare(threshold, g), LINKS)


def _per_class(links: DataFrame) -> DataFrame:
    return links.groupBy("rep").agg(F.sum("others").alias("others"), F.collect_set("root").alias("roots"))


def near_links(reps: DataFrame, threshold: float, overlap: int) -> DataFrame:
    """(rep, others, roots): rows that each class is linked to by graph search, verified in double precision.

    ``roots``: members that links connect it with. Members of dense shards are compared with each other.
    """
    members = shards(reps, overlap)
    dense = F.col("shard").endswith("!")
    in_dense = written(members.filter(dense).groupBy("rep").agg(F.collect_set("shard").alias("dense")), "dense-members")
    lists = members.filter(~dense).groupBy("shard").applyInArrow(_build, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graphs = members.filter(~dense).join(written(united, "graph"), "rep").join(in_dense, "rep", "left")
    found = (graphs.select("shard", "rep", "n", "vector", "near", "dense").groupBy("shard")
             .applyInArrow(lambda g: _find(threshold, g), FOUND))
    # an open shard has at most SHARD members, so these lists are short
    found = found.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
                                     F.collect_set("root").alias("roots"))
    others = F.aggregate("found", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    links = found.select("rep", others.alias("others"), F.explode("roots").alias("root"))
    # the count goes with one of the roots
    first = F.row_number().over(Window.partitionBy("rep").orderBy("root")) == 1
    links = links.withColumn("others", F.when(first, F.col("others")).otherwise(0))
    return written(_per_class(links.unionByName(dense_links(members.filter(dense).join(in_dense, "rep"), threshold))), "vector-links")


def exact_links(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, others, roots) by comparing all classes of a label."""
    members = _packed(reps.withColumn("shard", F.concat(_pack(), F.lit("!"))))
    return written(_per_class(dense_links(members.withColumn("dense", F.array("shard")), threshold)), "vector-links")


def audit(reps: DataFrame, links: DataFrame, threshold: float, n_queries: int | None = None) -> tuple[dict[str, float], float | None]:
    """(recall of each pack, recall of the others) on hash-chosen classes that have true links.

    A class's recall is the share of its true links that were found, a pack's (label and length) the mean of
    its classes'. A pack is judged by its own classes if AUDIT_LINKED of them have links or all were audited, else
    by those of all packs, and if even these are too few its recall is None: not known. The sample, spread
    over the packs, is broadcast and compared with all classes, a batch at a time.
    """
    n_queries = n_queries or AUDIT_QUERIES
    packs = reps.select(_pack().alias("pack"), "rep", "n", "v")
    sizes = packs.groupBy("pack").agg(F.count(F.lit(1)).alias("size"))
    # the first of each pack by hash; a large pack is thinned before it is ordered
    order = F.xxhash64("rep")
    thin = packs.join(sizes, "pack").filter(
        F.pmod(F.xxhash64("rep", F.lit("thin")), F.greatest(F.lit(1), (F.col("size") / (4 * n_queries)).cast("long"))) == 0)
    turn = F.row_number().over(Window.partitionBy("pack").orderBy(order, "rep"))
    chosen = thin.withColumn("_turn", turn).orderBy("_turn", order, "rep").limit(n_queries).collect()
    told: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for pack in {r["pack"] for r in chosen}:
        rows = [r for r in chosen if r["pack"] == pack]
        v = np.array([r["v"] for r in rows])
        told[pack] = np.array([r["rep"] for r in rows], np.int64), v / np.linalg.norm(v, axis=1, keepdims=True)

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for pack, rep, n, v in zip(*(b.column(c).to_pylist() for c in ("pack", "rep", "n", "v")), strict=True):
                if pack in told:
                    by.setdefault(pack, []).append((rep, n, v))
            queries, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for pack, rows in by.items():
                names, q = told[pack]
                x, n = np.array([r[2] for r in rows]), np.array([r[1] for r in rows], np.int64)
                ok = (q @ x.T) / np.linalg.norm(x, axis=1) >= threshold
                ok &= names[:, None] != np.array([r[0] for r in rows], np.int64)
                queries.append(names)
                counts.append(ok @ n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (queries, counts)],
                                             names=["rep", "true_links"])

    truth = packs.mapInArrow(true, "rep long, true_links long").groupBy("rep").agg(F.sum("true_links").alias("true_links")).filter("true_links > 0")
    found = {r["rep"]: min(1.0, (r["others"] or 0) / r["true_links"]) for r in
             truth.join(links.select("rep", "others"), "rep", "left").collect()}
    size = {r["pack"]: r["size"] for r in chosen}
    own = {pack: [found[r] for r in names.tolist() if r in found] for pack, (names, _) in told.items()}
    pooled = float(np.mean(list(found.values()))) if len(found) >= AUDIT_LINKED else None
    recall = {pack: float(np.mean(x)) if x else 1.0 for pack, x in own.items()
              if len(x) >= AUDIT_LINKED or len(told[pack][0]) == size[pack]}
    return recall, pooled


def all_links(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, others, roots) of all classes: by graph search where the audit shows AUDIT_RECALL, else by brute force."""
    done, todo = [], reps
    for overlap in OVERLAPS:
        links = near_links(todo, threshold, overlap)
        recall, pooled = audit(todo, links, threshold)
        rest = pooled is not None and pooled >= AUDIT_RECALL
        passed = {pack: x >= AUDIT_RECALL for pack, x in recall.items()}
        known = todo.sparkSession.createDataFrame(list(passed.items()), "pack string, _ok boolean")
        judged = (todo.withColumn("pack", _pack()).join(F.broadcast(known), "pack", "left")
                  .withColumn("_ok", F.coalesce("_ok", F.lit(rest))))
        done.append(links.join(judged.filter("_ok").select("rep"), "rep", "left_semi"))
        todo = written(judged.filter("not _ok").drop("_ok", "pack"), "vector-classes")
        if todo.isEmpty():
            break
    else:
        done.append(exact_links(todo, threshold))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine reaches the threshold. ``n_links``: other
    rows linked directly, equal vectors included; ``component_id``: the smallest vec_id reachable;
    ``kept``: whether that is the row's own. Null labels and invalid vectors link with nothing; a null
    vec_id links with nothing either. Repeated rows count as rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    reps, members = classes(rows.filter("vec_id is not null"))
    if reps.isEmpty():
        links = rows.sparkSession.createDataFrame([], "rep long, others long, roots array<long>")
    else:
        links = all_links(reps, threshold)
    joined = connected_components(links.select(F.col("rep").alias("a"), F.explode("roots").alias("b")))
    per = (reps.select("rep", "n").join(links.select("rep", "others"), "rep", "left")
           .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
           .select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                   F.coalesce("component", "rep").alias("component_id")))
    linked = members.join(per, "rep").select("vec_id", "n_links", "component_id").dropDuplicates(["vec_id"])
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
