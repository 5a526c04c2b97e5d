"""Sources and sinks (inventory A1-A8).

Fixed schemas at the edges (no schema inference on text), one multi-path scan for
many per-term files, and JSON with explicit map types.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from densel.operators.knn import vector_dimension
from densel.session import ensure_shipped

TERM_TABLE_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])

# Fallback names for the text column, in order.
TEXT_COLUMN_CANDIDATES = ("text", "Tweet", "tweet", "content", "Text")

METRICS_RECORD_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("balanced_accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("auc_roc", T.DoubleType()),
    T.StructField("class_distribution", T.MapType(T.StringType(), T.LongType())),
])

RESULTS_TYPE = "map<string,map<string,map<string,double>>>"


def _records_of(odd: set, header: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quoted records of the lines of file blocks, in the order they are read: whole ones, and parts at a block's ends.

    A line with an odd number of quotes opens or closes a quoted line break; ``odd`` has the blocks
    that start inside one. Part 0 of a block ends a record of an earlier block (or goes through it), part
    1 starts one that a later block ends.
    """
    block, lines, opened, part, first = None, [], False, False, False

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
            pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["path", "start", "part", "closed", "record"])

    def rest() -> list[tuple]:
        """What the block leaves open at its end."""
        return [(*block, 0 if part else 1, False, "\n".join(lines))] if lines else []

    for batch in batches:
        out: list[tuple] = []
        for path, start, line in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if (path, start) != block:
                out += rest()
                block, lines, first = (path, start), [], start == 0
                opened = part = (path, start) in odd
            lines.append(line)
            if line.count('"') % 2:
                opened = not opened
            if opened:
                continue
            if part:
                out.append((*block, 0, True, "\n".join(lines)))
            elif not (first and header):
                out.append((*block, None, True, "\n".join(lines)))
            lines, part, first = [], False, False
        if out:
            yield told(out)
    if block is not None and (out := rest()):
        yield told(out)


def quoted_records(spark: SparkSession, paths: list[str], header: bool = True) -> DataFrame:
    """(path, record) of CSV files whose quoted fields may hold line breaks, each file read by many tasks.

    Lines are read from byte ranges of the files. One pass counts the quotes of each range; whether a
    range starts inside quotes is the parity of those before it in its file. A second pass puts the lines of a range together
    to records; only the parts at ranges' ends are shuffled, and joined along the file. The driver holds the ranges
    that start inside quotes (at most one entry for each input split).
    """
    ensure_shipped(spark)
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd"))
              .withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1))
    odd = {(r["path"], r["start"]) for r in ranges.filter("inside").select("path", "start").collect()}
    found = lines.mapInArrow(lambda it: _records_of(odd, header, it), "path string, start bigint, part int, closed boolean, record string")
    whole = found.filter("part is null").select("path", "record")
    # along a file, an open part starts a record that the next closed part ends
    place = Window.partitionBy("path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.filter("part is not null").withColumn("n", F.coalesce(F.sum(F.col("closed").cast("int")).over(place), F.lit(0)))
    joined = parts.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("all"))
    return whole.unionByName(joined.select("path", F.array_join("all.record", "\n").alias("record")))


def read_term_tables(spark: SparkSession, paths: Sequence[str] | str, *,
                     schema: T.StructType = TERM_TABLE_SCHEMA,
                     term_pattern: str = r"([^/]+)\.csv$", header: bool = True) -> DataFrame:
    """A1: read one CSV per term in one scan and tag each row with the term taken from its file path.

    Fields may be quoted and then hold commas, line breaks and doubled quotes (a quote inside a field without
    quotes is not supported). Files of any size are read by as many tasks as they have splits; empty lines are skipped.
    """
    plist = [paths] if isinstance(paths, str) else list(paths)
    records = quoted_records(spark, plist, header).withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")
    row = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    return (records.select(row.alias("row"), F.regexp_extract("path", term_pattern, 1).alias("term"))
            .select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields], "term"))


def resolve_text_column(df: DataFrame) -> DataFrame:
    """A2: the text column is ``text``, else the first of the known names, else the first column not
    named label/term (case-insensitive); returned as ``text`` with the other columns."""
    cols = df.columns
    pick = None
    for c in TEXT_COLUMN_CANDIDATES:
        if c in cols:
            pick = c
            break
    if pick is None:
        rest = [c for c in cols if c.lower() not in ("label", "term")]
        if not rest:
            raise ValueError(f"no text column in {cols}")
        pick = rest[0]
    others = [c for c in cols if c != pick and c != "text"]
    return df.select(F.col(pick).alias("text"), *others)


def validate_aligned(text_df: DataFrame, vec_df: DataFrame, key: str, *, report_only: bool = False) -> DataFrame:
    """A3: require ``text``; default ``term='unknown'``; the text and vector key sets must match.

    Returns the aligned rows when every key matches and raises with the counts otherwise;
    ``report_only=True`` returns the one-row report (with the term-default count) instead.
    """
    if "text" not in text_df.columns:
        raise ValueError(f"text table must have a 'text' column; has {text_df.columns}")
    had_term = "term" in text_df.columns
    t = text_df if had_term else text_df.withColumn("term", F.lit("unknown"))
    rep = alignment_report(t, vec_df, key)
    if report_only:
        return rep.withColumn("term_defaulted", F.lit(not had_term))
    report = rep.first()
    if report["only_text"] or report["only_vectors"]:
        raise ValueError(f"text/vector mismatch: {report.asDict()}")
    return t.join(vec_df, key)


def alignment_report(text_df: DataFrame, vec_df: DataFrame, key: str) -> DataFrame:
    """A3 check: one row with counts of matched and one-sided keys (full outer join)."""
    a = text_df.select(F.col(key), F.lit(1).alias("_a"))
    b = vec_df.select(F.col(key), F.lit(1).alias("_b"))
    j = a.join(b, key, "full")
    return j.agg(F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).cast("bigint")
                 .alias("matched"),
                 F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).cast("bigint").alias("only_text"),
                 F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).cast("bigint").alias("only_vectors"))


def write_embeddings(df: DataFrame, path: str, *, term: str = "term", mode: str = "overwrite") -> None:
    """A4 sink: vectors as parquet partitioned by term (float32 arrays)."""
    out = df.withColumn("v", F.col("v").cast("array<float>")) if "v" in df.columns else df
    out.write.mode(mode).partitionBy(term).parquet(path)


def read_embeddings(spark: SparkSession, path: str, terms: Sequence[str] | None = None, *,
                    term: str = "term", vec: str = "v", check_dim: bool = True) -> DataFrame:
    """A4 source: vectors of the requested terms (partition pruning); a missing term is skipped.

    The dimension check is one aggregate (min size = max size).
    """
    df = spark.read.parquet(path)
    if terms is not None:
        df = df.filter(F.col(term).isin(list(terms)))
    if check_dim:
        vector_dimension(df, vec)
    return df


def read_weights_csv(spark: SparkSession, path: str, *, use_median: bool = False) -> DataFrame:
    """A5: ``term, average, median`` → ``(model, weight)`` choosing average or median."""
    schema = "term string, average double, median double"
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(F.col("term").alias("model"), F.col("median" if use_median else "average").alias("weight"))


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Header, no index column; text kept verbatim (no trimming of surrounding spaces)."""
    w = (df.write.mode(mode).option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_metrics_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """A7 sink: records-oriented metrics JSON (one object per line)."""
    df.write.mode(mode).json(path)


def read_metrics_json(spark: SparkSession, path: str, schema: T.StructType = METRICS_RECORD_SCHEMA) -> DataFrame:
    """A7 source with an explicit schema (``class_distribution`` as ``MAP<STRING,BIGINT>``)."""
    return spark.read.schema(schema).json(path)


def results_to_json_lines(long: DataFrame, *, model: str = "model", dataset: str = "dataset") -> DataFrame:
    """Nested results, one JSON object per model: ``{model: {dataset: {metric: value}}}``."""
    cell = long.groupBy(model, dataset).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_m"))
    per_model = cell.groupBy(model).agg(F.map_from_entries(F.collect_list(F.struct(dataset, "_m"))).alias("_d"))
    return per_model.select(F.to_json(F.create_map(F.col(model), F.col("_d"))).alias("value"))


def results_json_to_long(spark: SparkSession, path: str) -> DataFrame:
    """Nested ``{model: {dataset: {metric: value}}}`` JSON lines → ``(model, dataset, metric, value)``."""
    raw = spark.read.text(path)
    m = raw.select(F.from_json("value", RESULTS_TYPE).alias("m"))
    l1 = m.select(F.explode("m").alias("model", "d"))
    l2 = l1.select("model", F.explode("d").alias("dataset", "ms"))
    return l2.select("model", "dataset", F.explode("ms").alias("metric", "value"))
