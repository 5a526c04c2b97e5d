"""Derived inputs built by Spark from the driver tables (FIXTURES.md §3).

Each builder only reshapes the given tables into the schema an operator expects
(vectors with a term and a label, labelled texts, per-model scores); the
operators then do all of their work on these rows through the library code.
The ``*_SQL`` strings restate each fixture as a DuckDB CTE for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densel.functions.expressions import NEGATIVE_LABEL, POSITIVE_LABEL, md5_uniform
from densel.session import spread

# Fixed values of the fixtures.
TARGET_TERM = "t0"
MODELS = ("en", "fr", "de", "es")
DETECT_TERMS = ("eau", "ich", "que", "thou")
# A model name for each document, from its columns; the same text is SQL for Spark and DuckDB.
MODEL_NAME_SQL = (
    "CASE lang WHEN 'en' THEN 'ModernBERT-k' || CAST(n_chars % 1000 AS STRING) "
    "|| CASE WHEN n_chars % 2 = 0 THEN '_balanced' ELSE '' END || CASE WHEN n_chars % 3 = 0 THEN '-classifier' ELSE '-final' END "
    "WHEN 'de' THEN 'density_avg_' || source WHEN 'fr' THEN 'majority_' || source "
    "WHEN 'es' THEN 'weighted_avg_' || source ELSE source END")


TEXT_TABLE_KEYS = {"documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str, *, text: bool = True) -> DataFrame:
    """A driver table. Text tables are spread over the cores when their text is going to be read
    (``text=True``) and the file has fewer splits than cores; otherwise the scan is used as is."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLE_KEYS:
        if text:
            df = spread(df, TEXT_TABLE_KEYS[name])  # whole-text work: use every core even on one split
        else:
            df = df.drop("text")
    return df


def fx_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, term, label, v)``: term = 't'‖label, text label from the md5 uniform, v as doubles."""
    e = table(spark, sf_dir, "embeddings")
    u = md5_uniform(F.concat(F.lit("l:"), F.col("vec_id").cast("string")))
    return e.select(
        F.col("vec_id"),
        F.concat(F.lit("t"), F.col("label").cast("string")).alias("term"),
        F.when(u < 0.3, F.lit(POSITIVE_LABEL)).otherwise(F.lit(NEGATIVE_LABEL)).alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


def fx_text(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    """``(doc_id, text, term, label)``: documents joined to labels; term = lang; label from ``toxic``
    (without the text column when ``text=False``)."""
    d = table(spark, sf_dir, "documents", text=text).select("doc_id", *(["text"] if text else []), "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(lab, "doc_id").select(
        "doc_id", *(["text"] if text else []), F.col("lang").alias("term"),
        F.when(F.col("toxic") == 1, F.lit(POSITIVE_LABEL)).otherwise(F.lit(NEGATIVE_LABEL)).alias("label"))


def fx_docs(spark: SparkSession, sf_dir: str, *, text: bool = True) -> DataFrame:
    """``(doc_id, text, term)``: every document; term = lang (without the text column when ``text=False``)."""
    d = table(spark, sf_dir, "documents", text=text)
    return d.select("doc_id", *(["text"] if text else []), F.col("lang").alias("term"))


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, model, dataset, label, score)``: one score per text and per model (4 languages)."""
    t = fx_text(spark, sf_dir, text=False)
    m = t.select("doc_id", "term", "label", F.explode(F.array(*[F.lit(x) for x in MODELS])).alias("model"))
    u = md5_uniform(F.concat(F.lit("s:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("model")))
    bump = F.when(F.col("label") == POSITIVE_LABEL, F.lit(0.35)).otherwise(F.lit(0.10))
    return m.select("doc_id", "model", F.col("term").alias("dataset"), "label",
                    (F.lit(0.5) * u + bump).alias("score"))


def fx_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, l0, l1)``: the first two vector components used as two-class logits."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.element_at("embedding", 1).cast("double").alias("l0"),
                    F.element_at("embedding", 2).cast("double").alias("l1"))


# ---------------------------------------------------------------- DuckDB restatements
U_SQL = "((('0x'||substr(md5({s}),1,8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def u_sql(expr: str) -> str:
    return U_SQL.format(s=expr)


FX_VEC_SQL = (
    "fx_vec AS (SELECT vec_id, 't' || CAST(label AS VARCHAR) AS term, "
    f"CASE WHEN {u_sql(chr(39) + 'l:' + chr(39) + ' || CAST(vec_id AS VARCHAR)')} < 0.3 "
    "THEN 'hate' ELSE 'no hate' END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
)

FX_TEXT_SQL = (
    "fx_text AS (SELECT d.doc_id, d.text, d.lang AS term, "
    "CASE WHEN l.toxic = 1 THEN 'hate' ELSE 'no hate' END AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)

FX_DOCS_SQL = "fx_docs AS (SELECT doc_id, text, lang AS term FROM documents)"

FX_SCORES_SQL = (
    FX_TEXT_SQL + ", "
    "fx_scores AS (SELECT t.doc_id, m.model, t.term AS dataset, t.label, "
    f"0.5 * {u_sql(chr(39) + 's:' + chr(39) + ' || CAST(t.doc_id AS VARCHAR) || ' + chr(39) + ':' + chr(39) + ' || m.model')} "
    "+ CASE WHEN t.label = 'hate' THEN 0.35 ELSE 0.10 END AS score "
    "FROM fx_text t, (VALUES ('en'), ('fr'), ('de'), ('es')) m(model))"
)

FX_LOGITS_SQL = ("fx_logits AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS l0, "
                 "CAST(embedding[2] AS DOUBLE) AS l1 FROM embeddings)")

# normalised vectors (B5, zero vectors kept) and all ordered pairs with squared L2
NORM_SQL = "sqrt(list_sum(list_transform({v}, lambda y: y*y)))"
NV_SQL = ("nv AS (SELECT vec_id, term, label, CASE WHEN " + NORM_SQL.format(v="v") + " > 0 "
          "THEN list_transform(v, lambda x: x / " + NORM_SQL.format(v="v") + ") ELSE v END AS v FROM fx_vec)")
