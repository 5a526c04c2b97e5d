"""Splits, shuffles and capped weighted resampling (inventory F).

Randomness is the md5 uniform ``U(seed‖':'‖id[‖':'‖round])`` so results are
deterministic and restatable in SQL. "First n by a random key" is an exact rank
(``densel.operators.ranking``), never a gather into one task.

Capped weighted sampling (F7) in closed form: the sampler draws in rounds; while
all still-eligible rows fit, a round takes every one of them once, so only the last
(partial) round is weighted. With ``left = cap − prior`` draws still allowed per row,
round r holds the rows with ``left ≥ r``. Windows over the small (group, left) histogram
give each group's partial round r* and the number m still needed; rows get
``min(left, r*−1)`` whole-round copies plus one more if
they are among the first m of round r* by the Efraimidis–Spirakis key ``−ln(u)/w``
(weight ≤ 0 sorts last), ties by id. No plan passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densel.functions.expressions import md5_uniform
from densel.operators.ranking import exact_rank, join_small, join_written
from densel.session import materialise


def rand_key(seed: str, id_col: str = "id", round_col: Column | None = None) -> Column:
    parts = [F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")]
    if round_col is not None:
        parts += [F.lit(":"), round_col.cast("string")]
    return md5_uniform(F.concat(*parts))


# ------------------------------------------------------------------ F1, F5, F6
def union_terms(frames: Sequence[DataFrame], id_col: str = "id", *, fresh_key: bool = True) -> DataFrame:
    """stack tables by column name; optionally a fresh 0-based key over the stacked order.

    The fresh key is ``(input index, old id)`` ranked exactly, so it is deterministic.
    """
    out = None
    for i, f in enumerate(frames):
        t = f.withColumn("_src", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if not fresh_key:
        return out.drop("_src")
    # (input index, old id) is the unique key of the stacked table
    keyed = out.withColumn("_uk", F.struct(F.col("_src"), F.col(id_col)))
    return (exact_rank(keyed, None, [F.col("_src"), F.col(id_col)], out="row_id",
                       key_cols=["_src", id_col, "_uk"]).drop("_src", "_uk"))


def shuffle(df: DataFrame, seed: str = "42", *, id_col: str = "id", out: str = "position") -> DataFrame:
    """random order as an explicit 0-based position (by the md5 key, ties by id)."""
    t = df.withColumn("_u", rand_key(seed, id_col))
    return exact_rank(t, None, [F.col("_u"), F.col(id_col)], out=out, key_cols=["_u", id_col]).drop("_u")


def cap_sample(df: DataFrame, n: int = 5000, seed: str = "42", *, id_col: str = "id") -> DataFrame:
    """uniform sample without replacement of n rows, only if the table is larger than n."""
    t = df.withColumn("_u", rand_key(seed, id_col))
    flagged = first_by_uniform(t, "_u", id_col, [], lambda total: F.least(total, F.lit(int(n))))
    return flagged.filter(F.col("_first")).drop("_u", "_first")


# ------------------------------------------------------------------ F2, F3, F4
UNIFORM_BUCKETS = 65_536  # equal-width buckets of the md5 uniform for the two-level cut


def _same_keys(keys: list[str]) -> Column:
    """The null-safe join condition of a table and a small one whose keys are named ``_of_…``."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return same


def first_by_uniform(df: DataFrame, u: str, id_col: str, strata: list[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """Flag the first rows of each stratum in (u, id) order, without sorting or shuffling the table.

    ``u`` is uniform on (0, 1), so equal-width buckets of u hold about equal row counts. One
    aggregate counts rows per (stratum, bucket); a running sum over those counts finds the bucket
    where each stratum's cut falls. Only the rows of that one bucket (1/65,536 of a stratum) are ranked, to find the
    last (u, id) that is taken, and the table is compared with that point: one small row per stratum. ``wanted`` maps the column of a
    stratum's row counts to the number of rows to take. A null stratum is a stratum. Adds the boolean column ``_first``.
    Ids must be unique; a row with a null id counts as a row and is never first.
    """
    bucket = F.least(F.floor(F.col(u) * F.lit(float(UNIFORM_BUCKETS))), F.lit(UNIFORM_BUCKETS - 1)).cast("int")
    keys = list(strata) or ["_all"]
    of = [f"_of_{k}" for k in keys]
    t = df if strata else df.withColumn("_all", F.lit(0))
    narrow = t.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(u).alias("_cut_u"), F.col(id_col).alias("_cut_id"),
                      bucket.alias("_b"))
    cells = narrow.groupBy(*of, "_b").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*of)
    upto = F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("_upto", upto).withColumn("_take", wanted(F.sum("_c").over(whole)))
    need = F.col("_take") - (F.col("_upto") - F.col("_c"))
    cuts = (cells.filter((F.col("_upto") >= F.col("_take")) & (need > 0))
            .select(*[F.col(k).alias(f"_cut{k}") for k in of], F.col("_b").alias("_cut_b"), need.alias("_need")))
    in_cut = F.col("_b") == F.col("_cut_b")
    for k in of:
        in_cut = in_cut & F.col(k).eqNullSafe(F.col(f"_cut{k}"))
    rank = F.row_number().over(Window.partitionBy(*of).orderBy("_cut_u", "_cut_id"))
    last = (join_small(narrow, cuts, in_cut).withColumn("_rk", rank).filter(F.col("_rk") == F.col("_need"))
            .select(*of, "_cut_u", "_cut_id"))
    first = (F.col(u) < F.col("_cut_u")) | ((F.col(u) == F.col("_cut_u")) & (F.col(id_col) <= F.col("_cut_id")))
    return (join_small(t, last, _same_keys(keys), "left").withColumn("_first", F.coalesce(first, F.lit(False)))
            .drop(*of, "_cut_u", "_cut_id", "_all"))


def _split_by_rank(df: DataFrame, train_fraction: float, seed: str, id_col: str, strata: list[str]) -> DataFrame:
    """Per stratum, exactly ``round(f·n)`` (half to even) rows, first in (u, id) order, are 'train'."""
    t = df.withColumn("_u", rand_key(seed, id_col))
    share = F.lit(float(train_fraction))
    flagged = first_by_uniform(t, "_u", id_col, strata, lambda n: F.bround(share * n.cast("double"), 0).cast("bigint"))
    return (flagged.withColumn("split", F.when(F.col("_first"), F.lit("train")).otherwise(F.lit("test")))
            .drop("_u", "_first"))


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: str = "42", *, label: str = "label",
                     id_col: str = "id") -> DataFrame:
    """F2: per label exactly ``round(0.8·n)`` (half to even) rows are 'train', the rest 'test'."""
    return _split_by_rank(df, 1.0 - test_size, seed, id_col, [label])


def random_split(df: DataFrame, test_size: float = 0.2, seed: str = "42", *, id_col: str = "id") -> DataFrame:
    """the same without strata."""
    return _split_by_rank(df, 1.0 - test_size, seed, id_col, [])


def holdout_cases(df: DataFrame, case_fraction: float = 0.05, test_size: float = 0.2, seed: str = "42", *,
                  label: str = "label", id_col: str = "id") -> DataFrame:
    """first a test-case sample of ``round(f·n)`` rows ('case'), then a stratified split of the rest."""
    first = _split_by_rank(df, case_fraction, seed + ":case", id_col, [])
    cases = first.filter(F.col("split") == "train").withColumn("split", F.lit("case"))
    rest = first.filter(F.col("split") == "test").drop("split")
    return cases.unionByName(stratified_split(rest, test_size, seed, label=label, id_col=id_col))


# ------------------------------------------------------------------ F7 - F11
def sampling_weight(df: DataFrame, *, ratio: str = "log_density_ratio", group: str = "term",
                    out: str = "sampling_weight") -> DataFrame:
    """F8: ``exp(x − max x)`` per group (max from a grouped aggregate, joined back by size-checked broadcast)."""
    mx = df.groupBy(group).agg(F.max(ratio).alias("_mx"))
    return join_small(df, mx, group).withColumn(out, F.exp(F.col(ratio) - F.col("_mx"))).drop("_mx")


def round_plan(rows: DataFrame, need: DataFrame | Callable[[Column], Column], *, group: str, left: str) -> DataFrame:
    """The rounds of each group as a table: (group, ``_rounds``, ``_more``).

    A row may still be drawn ``left`` times, so the rounds between two neighbouring values of ``left`` draw the same
    rows; running sums over the (group, left) counts give the draws before each such stretch, and the stretch that
    reaches ``need`` the number of whole rounds and the draws wanted of the next. Null ``_rounds``: every draw is taken.
    ``need`` is a table (group, need), or a function of the column of rows that can be drawn. Groups that need nothing
    or have no rows are left out, and so is a null group.
    """
    cells = rows.filter(F.col(group).isNotNull()).groupBy(group, left).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(group)
    steps = whole.orderBy(left)
    drawn = F.sum("_c").over(steps.rowsBetween(Window.currentRow, Window.unboundedFollowing))   # rows in each of these rounds
    t = (cells.withColumn("_from", F.coalesce(F.lag(left).over(steps), F.lit(0))).withColumn("_rows", drawn)
         .withColumn("_size", (F.col(left) - F.col("_from")) * F.col("_rows"))
         .withColumn("_done", F.coalesce(F.sum("_size").over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    if callable(need):
        t = t.withColumn("_need", need(F.sum("_c").over(whole)).cast("bigint"))
    else:
        t = join_small(t, need.select(group, F.col("need").cast("bigint").alias("_need")), group)
    over = F.col("_need") - F.col("_done")
    here = (over > 0) & (over <= F.col("_size"))
    rounds = F.col("_from") + F.floor((over - 1) / F.col("_rows"))
    more = (over - 1) % F.col("_rows") + 1
    return (t.filter(F.col("_need") > 0).groupBy(group)
            .agg(F.max(F.when(here, rounds)).cast("int").alias("_rounds"), F.max(F.when(here, more)).alias("_more")))


def weighted_sample_capped(df: DataFrame, need, *, weight: str = "sampling_weight", cap: int = 10,
                           prior: str | None = None, group: str = "term", id_col: str = "id",
                           seed: str = "42") -> DataFrame:
    """draw ``need[group]`` rows per group by weight without replacement inside a round,
    each row at most ``cap`` times overall (``prior`` = draws already made).

    ``need`` is a dict, a table (group, need), or a function of the column of each group's rows that can
    still be drawn. Returns one row per drawn copy with ``draw`` = the round (1-based) of that copy.
    Only the candidates of the partial round are ranked, as (group, key, id); the last of them that is
    drawn is one small row per group, with which the rows are compared, so rows are not shuffled.
    """
    if isinstance(need, dict):
        of_group = df.schema[group].dataType.simpleString()
        need = df.sparkSession.createDataFrame([(g, int(n)) for g, n in need.items()], f"`{group}` {of_group}, need bigint")
    left = F.lit(int(cap)) - (F.coalesce(F.col(prior), F.lit(0)) if prior else F.lit(0))
    t = df.withColumn("_left", left.cast("int")).filter(F.col("_left") > 0)
    plan = round_plan(t, need, group=group, left="_left")
    u = rand_key(seed, id_col, F.col("_rounds") + 1)
    key = F.when(F.col(weight) > 0, -F.ln(u) / F.col(weight)).otherwise(F.lit(float("inf")))
    # the partial round, after the whole ones, has the rows with a draw left
    t = join_written(t, plan, group).withColumn("_key", F.when(F.col("_left") > F.col("_rounds"), key))
    cand = t.filter(F.col("_key").isNotNull()).select(group, F.col("_key").alias("_last_key"), F.col(id_col).alias("_last_id"), "_more")
    last = (exact_rank(cand, group, [F.col("_last_key"), F.col("_last_id")], out="_rk")
            .filter(F.col("_rk") == F.col("_more") - 1).select(F.col(group).alias(f"_of_{group}"), "_last_key", "_last_id"))
    drawn = (F.col("_key") < F.col("_last_key")) | ((F.col("_key") == F.col("_last_key")) & (F.col(id_col) <= F.col("_last_id")))
    copies = F.least(F.col("_left"), F.coalesce("_rounds", "_left")) + F.when(drawn, 1).otherwise(0)
    out = join_written(t, last, _same_keys([group]), "left").withColumn("_copies", copies).filter(F.col("_copies") > 0)
    return (out.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .drop("_left", "_rounds", "_more", "_copies", "_key", f"_of_{group}", "_last_key", "_last_id"))


def term_quota(mean_ratios: DataFrame, total: int, min_per_term: int, *, term: str = "term",
               mean_col: str = "mean_ratio") -> DataFrame:
    """minimum per term (reduced to total // T when it does not fit), then the remainder split by
    mean log ratio / Σ mean log ratio, truncated toward zero; additional ≤ 0 is skipped (0).

    Input has one row per term; the sums are one aggregate.
    """
    agg = mean_ratios.agg(F.count("*").alias("t"), F.sum(mean_col).alias("s")).first()
    n_terms, weight_sum = int(agg["t"]), agg["s"]
    min_q = int(min_per_term)
    remaining = int(total) - min_q * n_terms
    if remaining < 0:
        min_q = int(total) // max(n_terms, 1)
        remaining = int(total) - min_q * n_terms
    w = F.try_divide(F.col(mean_col), F.lit(float(weight_sum or 0.0)))  # NULL when the ratios sum to 0
    x = F.lit(float(remaining)) * w
    add = F.when(x > 0, F.floor(x)).otherwise(F.ceil(x))  # int(): truncation toward zero
    return mean_ratios.select(term, F.lit(min_q).cast("bigint").alias("min_quota"), w.alias("term_weight"),
                              F.greatest(add.cast("bigint"), F.lit(0).cast("bigint")).alias("additional"))


def repeat_small_term(rows: DataFrame, min_count: int | Column, cap: int, *, id_col: str = "id",
                      group: str | None = None) -> DataFrame:
    """a term too small for ``min_count`` under the cap: repeat its rows ``cap`` times (in
    row order) and keep the first ``min_count``; ``draw`` is the repetition index.

    With ``group`` every group is treated as its own term in one pass, and ``min_count`` may be a column. Rows are ranked
    once: of n rows, the one of rank r is drawn ceil((min_count - r) / n) times, so no more copies are made than are kept.
    """
    least = min_count if isinstance(min_count, Column) else F.lit(int(min_count))
    ranked = exact_rank(rows, group, [F.col(id_col).asc()], out="_rk")
    if group:
        sizes = rows.groupBy(F.col(group).alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
        ranked = join_small(ranked, sizes, F.col(group).eqNullSafe(F.col("_of"))).drop("_of")
    else:
        ranked = ranked.withColumn("_size", F.lit(rows.count()))  # one scalar of metadata
    copies = F.least(F.lit(int(cap)), F.ceil((least - F.col("_rk")) / F.col("_size"))).cast("int")
    kept = ranked.filter(F.col("_rk") < least).withColumn("_copies", copies).filter("_copies > 0")
    return kept.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_rk", "_size", "_copies")


def balanced_resample(rows: DataFrame, ratios: DataFrame, *, total: int, min_per_term: int, cap: int,
                      seed: str = "42", id_col: str = "id", term: str = "term") -> DataFrame:
    """density-ratio balanced resampling.

    ``rows``: (id, term, ...) labelled rows; ``ratios``: (id, log_density_ratio).
    Minimum phase per term (small terms by F10, others by F7), draw counts carried as a
    table, additional phase by term weight (F9) with the carried counts as prior, union,
    shuffle (F5). Sizes and quotas are a table of one row per term, joined to the rows; none reach the driver.
    Output: one row per drawn copy with ``phase``, ``draw``, ``sampling_weight``,
    ``log_density_ratio`` (NULL for small-term minimum rows) and ``position``.
    """
    base = materialise(sampling_weight(rows.join(ratios, id_col), group=term))
    stats = materialise(base.groupBy(term).agg(F.count(F.lit(1)).alias("_n"), F.avg("log_density_ratio").alias("mean_ratio")))
    quota = term_quota(stats, total, min_per_term, term=term).select(
        term, F.col("min_quota").alias("_least"), F.col("additional").alias("_additional"))
    small = F.col("_n") < F.col("_least") / int(cap)
    plan = materialise(join_small(stats.select(term, "_n"), quota, term).withColumn("_small", small))
    t = join_small(base, plan, term, known_rows=plan.count())
    nothing = F.lit(None).cast("double")
    repeated = (repeat_small_term(t.filter("_small"), F.col("_least"), cap, id_col=id_col, group=term)
                .withColumn("sampling_weight", nothing).withColumn("log_density_ratio", nothing))
    least = plan.filter("not _small").select(term, F.col("_least").alias("need"))
    first = weighted_sample_capped(t.filter("not _small"), least, cap=cap, group=term, id_col=id_col, seed=seed + ":min")
    phase1 = materialise(repeated.unionByName(first).withColumn("phase", F.lit(1)))
    # draws made: counted in the weighted branch; the small-term branch (Q21) records min(cap, least // n + 1) for every row
    counted = phase1.filter("not _small").groupBy(term, id_col).agg(F.count(F.lit(1)).cast("int").alias("_drawn"))
    recorded = F.least(F.lit(int(cap)), F.floor(F.col("_least") / F.col("_n")) + 1).cast("int")
    prior = F.when(F.col("_small"), recorded).otherwise(F.coalesce("_drawn", F.lit(0)))
    more = plan.filter("_additional > 0").select(term, F.col("_additional").alias("need"))
    again = t.filter("_additional > 0").join(counted, [term, id_col], "left").withColumn("_prior", prior)
    phase2 = (weighted_sample_capped(again, more, cap=cap, prior="_prior", group=term, id_col=id_col, seed=seed + ":add")
              .drop("_drawn", "_prior").withColumn("phase", F.lit(2)))
    out = materialise(phase1.unionByName(phase2).drop("_n", "_least", "_additional", "_small"))
    keyed = out.withColumn("_sk", F.concat_ws(":", F.col("phase").cast("string"), F.col(id_col).cast("string"),
                                              F.col("draw").cast("string")))
    t = keyed.withColumn("_u", md5_uniform(F.concat(F.lit(seed + ":shuffle:"), F.col("_sk"))))
    return exact_rank(t, None, [F.col("_u"), F.col("_sk")], out="position",
                      key_cols=["_u", "_sk"]).drop("_u", "_sk")
