"""Proportional stratified interleaving: shards of equal row counts that each match the source mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densel.llm.tables import KEY_RANGE, ranked, shuffle_key, written


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 8; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")


def interleave(rows: DataFrame, key: str, stratum: str, seed: str = "interleave") -> tuple[DataFrame, int]:
    """Add each row's ``position`` in a seeded order that spreads every stratum evenly; also the row count.

    Rows are shuffled by a seeded hash within their stratum and ranked; rank r of c rows gets the
    fraction (r + 0.5) / c, and all rows are ranked by that fraction. Any contiguous cut then holds
    each stratum in its share, to within a row. Null strata form a stratum; rows with equal keys are
    ordered by their other columns, and rows equal in all columns are interchangeable. The columns of
    ``rows`` travel through two shuffles, so pass narrow rows and join wide ones by the key.
    """
    n = rows.count()
    ties = [F.col(f"`{c}`") for c in rows.columns if c != key]
    keyed = rows.withColumn("_h", shuffle_key(seed, F.col(key)))
    in_stratum = ranked(keyed, stratum, F.col("_h") / F.lit(float(KEY_RANGE)),
                        [F.col("_h"), F.col(key), *ties], n, rank="_rank")
    totals = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    totals = totals.withColumnRenamed(stratum, "_stratum")
    fractional = (in_stratum.join(totals, F.col(stratum).eqNullSafe(F.col("_stratum")))
                  .withColumn("_f", (F.col("_rank") + F.lit(0.5)) / F.col("_c")))
    out = ranked(fractional, None, F.col("_f"), [F.col("_f"), F.col("_h"), F.col(key), *ties], n, rank="position")
    return out.drop("_h", "_rank", "_stratum", "_c", "_f"), n


def shard(rows: DataFrame, key: str, stratum: str, n_shards: int, seed: str = "interleave") -> DataFrame:
    """Add ``shard`` (0 .. n_shards-1, row counts at most one apart) and ``slot`` (gapless from 0 in a shard)."""
    placed, n = interleave(rows, key, stratum, seed)
    if not n:
        return placed.drop("position").withColumns({"shard": F.lit(0).cast("int"), "slot": F.lit(0).cast("long")})
    s = F.expr(f"(position * {n_shards}L) div {n}L")
    start = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    return (placed.withColumn("shard", s.cast("int"))
            .withColumn("slot", (F.col("position") - start).cast("long")).drop("position"))


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: str = "interleave") -> DataFrame:
    """Shard documents by the ``rows`` law: (doc_id, source, size, text_crc32, shard, slot).

    size: UTF-8 bytes of the text plus 8; text_crc32: of the UTF-8 text. A null text counts as empty,
    a null source is a source, an empty table gives no rows. Other columns are not read.
    """
    narrow = written(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"),
                                 F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")), "shard-rows")
    return shard(narrow, "doc_id", "source", n_shards, seed)
