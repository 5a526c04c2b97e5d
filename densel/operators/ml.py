"""Distributed text/vector ML surface (inventory J1-J6), re-aimed to DataFrame jobs.

Transformer encoders and fine-tuning are single-GPU jobs in the reference; here the
same roles are played by sparse hashed TF-IDF vectors (``embed_text``), ridge logistic regressions
for all terms at once (one job per iteration, whatever the number of terms), a loss weighted by density, and a
principal component analysis from grouped outer products. Models are tables. Batched Python
inference (``score_text``) goes through ``mapInPandas`` with Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densel.operators.ranking import exact_rank, join_small
from densel.session import ensure_shipped, materialise

ModelFn = Callable[[list], tuple[list, list]]


NOT_A_WORD = r"[^\p{L}\p{N}]+"
SPARSE = "array<struct<index:int,weight:double>>"


def count_hashed_words(df: DataFrame, *, text: str, id_col: str, num_features: int) -> DataFrame:
    """(id, ``pairs`` of (index, n) by index): how often the words of a text (lower-cased runs of letters and digits) fall on an index.

    The index is the first 32 bits of the word's md5 modulo ``num_features``. A text without words has no row. The
    words of a row are counted where they are split; only the pairs travel, to meet other rows of the same id.
    """
    ensure_shipped(df.sparkSession)
    types = dict(df.dtypes)
    words = df.select(id_col, F.split(F.lower(F.col(text)), NOT_A_WORD).alias("_words"))
    each = words.mapInArrow(_counter(int(num_features)), f"{id_col} {types[id_col]}, _pairs {COUNTS}")
    lists = each.groupBy(id_col).agg(F.collect_list("_pairs").alias("_lists"))   # as many as rows of an id
    total = F.aggregate(F.flatten("_lists"), F.create_map().cast("map<int,bigint>"), lambda m, p: F.map_concat(
        F.map_filter(m, lambda k, v: k != p["index"]),
        F.create_map(p["index"], p["n"] + F.coalesce(F.try_element_at(m, p["index"]), F.lit(0).cast("bigint")))))
    merged = F.array_sort(F.transform(F.map_entries(total), lambda e: F.struct(e["key"].alias("index"), e["value"].alias("n"))))
    return lists.select(id_col, F.when(F.size("_lists") == 1, F.col("_lists")[0]).otherwise(merged).cast(COUNTS).alias("pairs"))


COUNTS = "array<struct<index:int,n:bigint>>"
TEXTS_AT_ONCE = 2048       # texts whose words are counted together
WORDS_KEPT = 1 << 18       # words whose index a task remembers


def _indexer(num_features: int) -> Callable[[str], int]:
    from functools import lru_cache
    from hashlib import md5

    return lru_cache(maxsize=WORDS_KEPT)(lambda w: int(md5(w.encode("utf-8")).hexdigest()[:8], 16) % num_features)


def _counter(num_features: int) -> Callable:
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        index_of = _indexer(num_features)
        kind = pa.struct([("index", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                lists = part.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                index = np.array([index_of(w) if w else -1 for w in coded.dictionary.to_pylist()], dtype=np.int64)
                at = index[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
                key = (np.repeat(np.arange(part.num_rows), sizes) * num_features + at)[at >= 0]
                key, n = np.unique(key, return_counts=True)
                row, at = np.divmod(key, num_features)
                found, lengths = np.unique(row, return_counts=True)
                pairs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], fields=list(kind))
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found)), pa.ListArray.from_arrays(ends, pairs)],
                                                 names=[batch.schema.names[0], "_pairs"])
    return run


def fit_idf(counts: DataFrame, n_rows: int) -> DataFrame:
    """(index, idf) with ``idf = ln((rows + 1) / (rows with the index + 1))``; at most ``num_features`` rows."""
    df = F.count(F.lit(1)).cast("double")
    return (counts.select(F.explode("pairs.index").alias("index")).groupBy("index")
            .agg(F.ln(F.lit(float(n_rows + 1)) / (df + 1.0)).alias("idf")))


def sparse_vectors(ids: DataFrame, counts: DataFrame, idf: DataFrame, *, id_col: str, num_features: int, out: str) -> DataFrame:
    """``ids`` with the L2-normalised TF-IDF vector of each id as (index, weight) pairs, by index; empty without words.

    The IDF table, at most ``num_features`` numbers, goes to the tasks; an index that it lacks is left out.
    """
    table = np.full(int(num_features), np.nan)
    for r in idf.collect():
        table[r["index"]] = r["idf"]
    weigh = _weigher(counts.sparkSession.sparkContext.broadcast(table))
    weighted = counts.select(id_col, "pairs").mapInArrow(weigh, f"{id_col} {dict(counts.dtypes)[id_col]}, _weighted {SPARSE}")
    return (ids.join(weighted, id_col, "left")
            .withColumn(out, F.coalesce("_weighted", F.array()).cast(SPARSE)).drop("_weighted"))


def _weigher(told) -> Callable:
    def run(batches):
        import pyarrow as pa

        table = told.value
        kind = pa.struct([("index", pa.int32()), ("weight", pa.float64())])
        for batch in batches:
            row, index, n = _flat(batch.column(1))
            known = ~np.isnan(table[index])
            row, index, n = row[known], index[known], n[known]
            w = n * table[index]
            norm = np.sqrt(np.bincount(row, weights=w * w, minlength=batch.num_rows))[row]
            w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            pairs = pa.StructArray.from_arrays([pa.array(index, pa.int32()), pa.array(w, pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                                             names=[batch.schema.names[0], "_weighted"])
    return run


def _flat(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, number) of all pairs of an Arrow column of pairs; a null list has none."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    pairs = lists.flatten()
    return (np.repeat(np.arange(len(lists)), sizes), pairs.field(0).to_numpy(zero_copy_only=False).astype(np.int64),
            pairs.field(1).to_numpy(zero_copy_only=False).astype(np.float64))


def embed_text(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", num_features: int = 1 << 12,
               out: str = "v") -> DataFrame:
    """Text → L2-normalised TF-IDF vector as ``array<struct<index, weight>>``; nothing dense is built.

    Words are counted once per text and the counts written; a null or empty text has an empty vector. Ids must be unique.
    """
    counts = materialise(count_hashed_words(df, text=text, id_col=id_col, num_features=num_features))
    return sparse_vectors(df.select(id_col), counts, fit_idf(counts, df.count()), id_col=id_col, num_features=num_features, out=out)


def embed_text_with(df: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], *,
                    text: str = "text", id_col: str = "doc_id", batch_size: int = 128, out: str = "v") -> DataFrame:
    """J1 with a pluggable encoder: ``make_encoder()`` loads a model once per Python worker and
    returns ``encode(texts: ndarray[str]) -> ndarray[n, dim]``; Spark feeds it batches of
    ``batch_size`` texts (``predict_batch_udf``)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    ensure_shipped(df.sparkSession)
    udf = predict_batch_udf(make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return df.select(id_col, udf(F.col(text)).alias(out))


def lexical_model() -> ModelFn:
    """A small stand-in classifier with the ``texts -> (predictions, confidences)`` contract:
    the share of exclamation marks and capitals over the whole text, squashed to (0, 1)."""
    import regex

    capital = regex.compile(r"\p{Lu}")

    def score(texts: list) -> tuple[list, list]:
        n = np.array([max(len(t or ""), 1) for t in texts], dtype=np.float64)
        caps = np.array([len(capital.findall(t or "")) for t in texts], dtype=np.float64)
        bangs = np.array([(t or "").count("!") for t in texts], dtype=np.float64)
        p = 1.0 / (1.0 + np.exp(-(20.0 * caps / n + 5.0 * bangs / n - 1.0)))
        return np.where(p >= 0.5, "hate", "no hate").tolist(), p.tolist()

    return score


def linear_model(idf: dict[int, float], weights: list[float]) -> ModelFn:
    """A trained model of :func:`fit_term_models` as a batch scorer: at most ``num_features`` numbers of each kind.

    Words, their indexes and TF-IDF weights are those of :func:`embed_text`; a null text is scored by the bias alone.
    """
    from collections import Counter

    import regex

    word, index_of = regex.compile(r"[\p{L}\p{N}]+"), _indexer(len(weights) - 1)

    def margin(text: str) -> float:
        counts = Counter(map(index_of, word.findall(text.lower())))
        x = {i: n * idf[i] for i, n in counts.items() if i in idf}
        norm = sum(v * v for v in x.values()) ** 0.5
        return weights[-1] + (sum(v * weights[i] for i, v in x.items()) / norm if norm > 0 else 0.0)

    def score(texts: list) -> tuple[list, list]:
        p = 1.0 / (1.0 + np.exp(-np.array([margin(t or "") for t in texts], dtype=np.float64)))
        return np.where(p >= 0.5, "hate", "no hate").tolist(), p.tolist()

    return score


def score_text(df: DataFrame, models: dict[str, Callable[[], ModelFn]], *, text: str = "text", id_col: str = "doc_id",
               batch_size: int = 128) -> DataFrame:
    """Batched inference of several models in one pass → long ``(id, model, prediction, score)``.

    ``models`` maps a name to a loader, called once per task; the loaded model maps a list of texts
    (None for null) to predictions and confidences. Texts are read once for all models.
    """
    ensure_shipped(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {name: load() for name, load in models.items()}
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[s:s + batch_size]
                for name, model in loaded.items():
                    preds, confs = model(chunk[text].tolist())
                    yield pd.DataFrame({id_col: chunk[id_col].to_numpy(), "model": name,
                                        "prediction": preds, "score": np.asarray(confs, dtype=np.float64)})

    schema = f"{id_col} bigint, model string, prediction string, score double"
    return df.select(id_col, text).mapInPandas(run, schema)


ITERATIONS = 12
RIDGE = 0.01
STEP = 1.0 / (0.5 + RIDGE)         # the loss of unit vectors and a bias bends by at most 1/4 · 2, plus the ridge
MOMENTUM = (1 - (RIDGE * STEP) ** 0.5) / (1 + (RIDGE * STEP) ** 0.5)


def _margin(vec: str, weights: str) -> Column:
    """The sum of a sparse vector's weights times a model's, plus the bias, which is the model's last number."""
    return F.aggregate(vec, F.element_at(weights, -1), lambda a, p: a + p["weight"] * F.element_at(F.col(weights), p["index"] + 1))


MAX_WEIGHTS = 1 << 22      # numbers of the models that are fitted or sent to tasks together: 32 MB


def fit_logistic(rows: DataFrame, *, group: str, label: str, vec: str, weight: str, num_features: int,
                 iterations: int = ITERATIONS) -> DataFrame:
    """One ridge logistic regression per group, as many in the same jobs as ``MAX_WEIGHTS`` allows: (group, ``weights`` array, the bias last).

    Accelerated gradient steps on the weighted mean loss. In an iteration the groups' weights go to the tasks, each sums
    the gradients of its rows by group, and Spark adds them up by (group, index); rows are neither shuffled nor
    collected, so a large group does not matter, and with many groups they are fitted a part at a time. ``rows`` is
    read once per iteration: pass a written table.
    """
    spark, width = rows.sparkSession, int(num_features) + 1
    ensure_shipped(spark)
    totals = materialise(rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sum(weight).alias("_total")))
    parts = max(1, -(-totals.count() * width // MAX_WEIGHTS))
    mine = lambda k: F.pmod(F.xxhash64(group), F.lit(parts)) == k
    kind = dict(rows.dtypes)[group]
    out = spark.createDataFrame([], f"{group} {kind}, weights array<double>")
    for k in range(parts):
        found = totals.filter(mine(k)).collect()   # about MAX_WEIGHTS / width groups
        if not found:
            continue
        number = {r[group]: i for i, r in enumerate(found)}
        total = np.array([r["_total"] for r in found], dtype=np.float64)[:, None]
        part = rows.filter(mine(k) & F.col(group).isNotNull()).select(
            group, vec, F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_wt"))
        w = ahead = np.zeros((len(found), width))
        ridge = np.append(np.full(width - 1, RIDGE), 0.0)
        for _ in range(int(iterations)):
            told = spark.sparkContext.broadcast((number, ahead))
            sums = (part.mapInArrow(_gradients(told), "_i int, _s array<double>").select("_i", F.posexplode("_s").alias("_j", "_g"))
                    .groupBy("_i", "_j").agg(F.sum("_g").alias("_g"))
                    .groupBy("_i").agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_g"))), lambda p: p["_g"]).alias("_s")))
            g = np.zeros_like(ahead)
            for r in sums.collect():
                g[r["_i"]] = r["_s"]
            told.destroy()
            new = ahead - STEP * (g / total + ridge * ahead)
            w, ahead = new, new + MOMENTUM * (new - w)
        out = out.unionByName(materialise(spark.createDataFrame([(r[group], w[i].tolist()) for i, r in enumerate(found)], out.schema)))
    return out


def _gradients(told) -> Callable:
    """The sum, for each group that a task meets, of its rows' gradients, the bias last."""
    def run(batches):
        import pyarrow as pa

        number, models = told.value
        width, sums = models.shape[1], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            i = np.array([number[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy(zero_copy_only=False)]
            y, wt = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            row, index, value = _flat(batch.column(1))
            margin = models[i, -1] + np.bincount(row, weights=value * models[i[row], index], minlength=len(i))
            e = wt * (1.0 / (1.0 + np.exp(-margin)) - y)
            here, at = np.unique(i, return_inverse=True)
            g = np.bincount(at[row] * width + index, weights=e[row] * value, minlength=len(here) * width).reshape(len(here), width)
            g[:, -1] = np.bincount(at, weights=e, minlength=len(here))
            for k, j in enumerate(here.tolist()):
                sums[j] = sums[j] + g[k] if j in sums else g[k].copy()
        for j, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([g], pa.list_(pa.float64()))], names=["_i", "_s"])
    return run


def fit_term_models(df: DataFrame, *, label: str = "label", text: str = "text", term: str = "term", id_col: str = "doc_id",
                    num_features: int = 1 << 12, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J3, fitting: tables of (index, idf), (term, weights) and the terms left out for having one class.

    The features (hashed TF-IDF over all rows) are computed once and written; all terms are fitted in the same jobs.
    Null terms and labels teach nothing. Ids must be unique.
    """
    counts = materialise(count_hashed_words(df, text=text, id_col=id_col, num_features=num_features))
    return _fit_counted(counts, df, label=label, term=term, id_col=id_col, num_features=num_features, iterations=iterations)


def _fit_counted(counts: DataFrame, df: DataFrame, *, label: str, term: str, id_col: str, num_features: int, iterations: int):
    idf = materialise(fit_idf(counts, df.count()))
    known = df.filter(F.col(term).isNotNull() & F.col(label).isNotNull()).select(id_col, term, F.col(label).cast("double").alias("_y"))
    classes = materialise(known.groupBy(term).agg((F.min("_y") < F.max("_y")).alias("_two")))
    usable = join_small(known, classes.filter("_two").select(term), term)
    rows = sparse_vectors(usable, counts, idf, id_col=id_col, num_features=num_features, out="_v").withColumn("_weight", F.lit(1.0))
    models = fit_logistic(materialise(rows), group=term, label="_y", vec="_v", weight="_weight",
                          num_features=num_features, iterations=iterations)
    return idf, models.withColumnRenamed(term, "model"), classes.filter("not _two").select(term)


def save_term_models(idf: DataFrame, models: DataFrame, path: str) -> None:
    """Write what :func:`fit_term_models` returns below a shared path, as Parquet tables ``idf`` and ``models``."""
    idf.write.parquet(f"{path}/idf")
    models.write.parquet(f"{path}/models")


def load_term_models(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables that :func:`save_term_models` wrote."""
    return spark.read.parquet(f"{path}/idf"), spark.read.parquet(f"{path}/models")


def score_term_models(idf: DataFrame, models: DataFrame, df: DataFrame, *, text: str = "text", id_col: str = "doc_id",
                      num_features: int = 1 << 12, counts: DataFrame | None = None) -> DataFrame:
    """Every model's score of every row: long ``(id, model, score)``; without models there are no rows.

    Models are numbered; a row is repeated per number and joined to the model's weights (a broadcast join up to
    ``MAX_WEIGHTS`` of them). ``num_features`` must be that of the fit. ``counts``: the rows' written word counts, if there are any.
    """
    numbered = materialise(exact_rank(models, None, [F.col("model")], out="_i", key_cols=["model"]))
    n = numbered.count()   # of a written table, a row per model
    if n == 0:
        return df.select(id_col, F.lit("").alias("model"), F.lit(0.0).alias("score")).limit(0)
    if counts is None:
        counts = materialise(count_hashed_words(df, text=text, id_col=id_col, num_features=num_features))
    rows = sparse_vectors(df.select(id_col), counts, idf, id_col=id_col, num_features=num_features, out="_v")
    each = rows.select(id_col, "_v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("_i"))
    few = n if n * (int(num_features) + 1) <= MAX_WEIGHTS else None
    return join_small(each, numbered, "_i", known_rows=few).select(id_col, "model", (1.0 / (1.0 + F.exp(-_margin("_v", "weights")))).alias("score"))


def fit_term_classifiers(df: DataFrame, *, label: str = "label", text: str = "text", term: str = "term",
                         id_col: str = "doc_id", num_features: int = 1 << 12, iterations: int = ITERATIONS) -> DataFrame:
    """One classifier per term, and every model's score of every row → long ``(id, model, score)``.

    A term with a single class trains no classifier (see :func:`fit_term_models` for those left out).
    """
    counts = materialise(count_hashed_words(df, text=text, id_col=id_col, num_features=num_features))   # for the fit and the scores
    idf, models, _ = _fit_counted(counts, df, label=label, term=term, id_col=id_col, num_features=num_features, iterations=iterations)
    return score_term_models(idf, models, df, text=text, id_col=id_col, num_features=num_features, counts=counts)


def fit_density_weighted(df: DataFrame, *, label: str = "label", text: str = "text", weight: str = "density_weight",
                         id_col: str = "doc_id", num_features: int = 1 << 12, iterations: int = ITERATIONS) -> DataFrame:
    """One classifier whose loss is weighted by the density weight; rows with a null label or weight teach nothing."""
    counts = materialise(count_hashed_words(df, text=text, id_col=id_col, num_features=num_features))
    ids = df.select(id_col, F.lit(0).alias("_one"), F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_weight"))
    rows = materialise(sparse_vectors(ids, counts, fit_idf(counts, df.count()), id_col=id_col, num_features=num_features, out="_v"))
    known = rows.filter(F.col("_y").isNotNull() & F.col("_weight").isNotNull())
    model = fit_logistic(known, group="_one", label="_y", vec="_v", weight="_weight", num_features=num_features, iterations=iterations)
    return join_small(rows, model, "_one", known_rows=1).select(id_col, (1.0 / (1.0 + F.exp(-_margin("_v", "weights")))).alias("score"))


def fixed_length_tokens(df: DataFrame, length: int = 140, *, text: str = "text", pad: str = "[PAD]") -> DataFrame:
    """Split on spaces, truncate or pad to ``length`` tokens, with a 1/0 attention mask."""
    kept = F.slice(F.split(F.col(text), " ", int(length) + 1), 1, length)   # what follows the last token is not split
    n_real = F.greatest(F.coalesce(F.size("_kept"), F.lit(0)), F.lit(0))
    padded = F.concat("_kept", F.array_repeat(F.lit(pad), F.lit(length) - n_real))
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), F.lit(length) - n_real))
    return df.withColumn("_kept", kept).select(*df.columns, padded.alias("tokens"), mask.alias("mask"))


POWER_STEPS = 300


def fit_pca(df: DataFrame, *, k: int = 2, vec: str = "v", steps: int = POWER_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """J6, fitting: (means, components by row, the variance along each, the total variance).

    Tasks sum outer products of their centred vectors, which are summed by (row, column): d² numbers for vectors of
    length d reach the driver. There ``steps`` block power steps start from the cosine basis, so the result is the same
    in every run; a component's largest number (the first of equals) is positive. Components beyond the rank are zero. Null vectors are left out.
    """
    known = df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("_v"))
    found = known.agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector("_v")).alias("m")).first()
    n, means = int(found["n"]), found["m"].toArray()
    centred = known.select(F.zip_with("_v", F.array(*[F.lit(float(m)) for m in means]), lambda x, m: x - m).alias("_c"))
    d = len(means)

    def outer(batches):
        import pyarrow as pa

        total = np.zeros((d, d))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": pa.array(list(total), pa.list_(pa.float64()))})

    sums = (centred.mapInArrow(outer, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "s"))
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    cov = np.zeros((d, d))
    for r in sums:
        cov[r["i"], r["j"]] = r["s"] / max(n - 1, 1)
    q = np.cos(np.pi * np.arange(k)[:, None] * (np.arange(d)[None, :] + 0.5) / d)
    for _ in range(int(steps)):
        q = q @ cov
        for a in range(k):
            for b in range(a):
                q[a] -= (q[b] @ q[a]) * q[b]
            size = np.sqrt(q[a] @ q[a])
            q[a] = q[a] / size if size > 1e-150 else 0.0
    for a in range(k):
        q[a] *= -1.0 if q[a][np.argmax(np.abs(q[a]))] < 0 else 1.0
    return means, q, np.einsum("ai,ij,aj->a", q, cov, q), float(np.trace(cov))


def pca_project(fit_df: DataFrame, apply_df: DataFrame, *, k: int = 2, id_col: str = "id", vec: str = "v",
                steps: int = POWER_STEPS) -> DataFrame:
    """Principal components fitted on ``fit_df`` and applied to ``apply_df``: (id, pc1, pc2, …)."""
    means, components, _, _ = fit_pca(fit_df, k=k, vec=vec, steps=steps)
    centre = F.array(*[F.lit(float(m)) for m in means])
    along = []
    for i, c in enumerate(components):
        terms = F.zip_with(F.zip_with(F.col(vec), centre, lambda x, m: x - m), F.array(*[F.lit(float(x)) for x in c]), lambda x, w: x * w)
        along.append(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias(f"pc{i + 1}"))
    return apply_df.select(id_col, *along)
