"""DuckDB restatements of the registered queries (the correctness oracle).

Each SQL reads the driver's pre-registered views (``embeddings``, ``documents``,
``labels``, ...), rebuilds the fixture as CTEs and computes the query by brute force
(all pairs for kNN, window ranks for cuts). Doubles are rounded to 6 decimals, counts
cast to BIGINT, as in the Spark queries.
"""

from __future__ import annotations

from densel.plans import catalog as C
from densel.plans.fixtures import FX_DOCS_SQL, FX_LOGITS_SQL, FX_SCORES_SQL, FX_TEXT_SQL, FX_VEC_SQL, NV_SQL, u_sql

T0 = "'t0'"


def U(expr: str) -> str:
    return u_sql(expr)


# ------------------------------------------------------------------ density fragments
def dens_ctes(ks=C.KS) -> str:
    """fx_vec, nv, all pairs across different terms, ranked; ``dens`` has every (row, other term, k)."""
    klist = ", ".join(str(int(k)) for k in ks)
    return f"""{FX_VEC_SQL}, {NV_SQL},
nref AS (SELECT term, count(*) AS n FROM nv GROUP BY term),
pairs AS (SELECT a.vec_id AS qid, a.term AS source_term, b.term AS target_term, len(a.v) AS d,
                 power(list_distance(a.v, b.v), 2) AS d2 FROM nv a JOIN nv b ON a.term <> b.term),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, target_term ORDER BY d2) - 1 AS pos FROM pairs),
ks AS (SELECT unnest([{klist}]) AS k),
dens0 AS (SELECT rk.qid, rk.source_term, rk.target_term, ks.k::BIGINT AS k, nref.n::BIGINT AS n_ref,
                 least(ks.k, nref.n - 1)::BIGINT AS k_used, rk.d2 AS kth_distance,
                 (rk.d / 2.0) * ln(pi()) + rk.d * ln(greatest(rk.d2, 1e-10)) - lgamma(rk.d / 2.0 + 1) AS log_volume
          FROM rk JOIN nref ON rk.target_term = nref.term JOIN ks ON rk.pos = least(ks.k, nref.n - 1)),
dens AS (SELECT *, CASE WHEN k_used <= 0 THEN '-inf'::DOUBLE ELSE ln(k_used) END - ln(n_ref) - log_volume
                AS log_density FROM dens0)"""


D1ROWS = f"""d1 AS (SELECT d.qid AS vec_id, f.term, f.label, d.n_ref, d.k_used, d.kth_distance, d.log_volume,
                 d.log_density FROM dens d JOIN fx_vec f ON f.vec_id = d.qid
          WHERE d.k = {C.K} AND d.target_term = {T0} AND d.source_term <> {T0})"""

RATIO = f"""ratio AS (SELECT qid, source_term AS term,
    max(CASE WHEN target_term = {T0} THEN log_density END) AS density_to_target,
    avg(CASE WHEN target_term <> {T0} THEN log_density END) AS avg_density_to_others
  FROM dens WHERE k = {C.K} AND source_term <> {T0} GROUP BY qid, source_term),
ratio2 AS (SELECT *, CASE WHEN avg_density_to_others IS NULL THEN density_to_target
                     ELSE density_to_target - avg_density_to_others END AS log_density_ratio
           FROM ratio WHERE density_to_target IS NOT NULL)"""

MATRIX = f"""cells AS (SELECT source_term, target_term, avg(log_density) AS avg_density FROM dens
                WHERE k = {C.K} GROUP BY source_term, target_term),
terms AS (SELECT DISTINCT term FROM fx_vec),
matrix AS (SELECT a.term AS source_term, b.term AS target_term,
    CASE WHEN a.term = b.term THEN 0.0 ELSE coalesce(c.avg_density, 0.0) END AS avg_density
  FROM terms a CROSS JOIN terms b LEFT JOIN cells c ON c.source_term = a.term AND c.target_term = b.term)"""

E1SEL = f"""e1n AS (SELECT floor({C.TOP_FRACTION}::DOUBLE * count(*))::BIGINT AS n FROM d1),
e1 AS (SELECT d1.* FROM d1, e1n QUALIFY row_number() OVER (ORDER BY log_density DESC, vec_id) <= e1n.n)"""

WEIGHTS = f"""wt AS (SELECT qid AS vec_id, term, log_density_ratio,
    exp(log_density_ratio - max(log_density_ratio) OVER (PARTITION BY term)) AS sampling_weight FROM ratio2)"""


# ------------------------------------------------------------------ score / metric fragments
SC = f"""{FX_SCORES_SQL},
sc AS (SELECT doc_id, model, dataset, CASE WHEN label = 'hate' THEN 1 ELSE 0 END AS y,
              CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, score FROM fx_scores)"""


def conf_sql(name: str, src: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys},
    sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn,
    sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
    sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn,
    sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp
  FROM {src} GROUP BY {keys})"""


def metrics_sql(name: str, conf: str, balanced: str = "manual") -> str:
    prec = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END"
    rec = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END"
    tnr = "CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0.0 END"
    if balanced == "manual":
        bal = f"CASE WHEN tn + fp > 0 THEN ({rec} + {tnr}) / 2 ELSE {rec} END"
    else:
        bal = (f"CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN ({rec} + {tnr}) / 2 WHEN tp + fn > 0 THEN {rec} "
               f"WHEN tn + fp > 0 THEN {tnr} END")
    return f"""{name}0 AS (SELECT *, CASE WHEN tn + fp + fn + tp > 0 THEN (tp + tn)::DOUBLE / (tn + fp + fn + tp) END
       AS accuracy, {bal} AS balanced_accuracy, {prec} AS precision, {rec} AS recall FROM {conf}),
{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
       AS f1_score FROM {name}0)"""


def auc_sql(name: str, src: str, keys: str, single: str = "0.5") -> str:
    part = f"PARTITION BY {keys}"
    return f"""{name}_ps AS (SELECT {keys}, score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {keys}, score),
{name}_c AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
       AS below FROM {name}_ps),
{name} AS (SELECT {keys}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
       THEN sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) ELSE {single} END AS auc_roc
  FROM {name}_c GROUP BY {keys})"""


BOARD = f"""{conf_sql('cf', 'sc', 'model')}, {metrics_sql('mt', 'cf')}, {auc_sql('au', 'sc', 'model')},
lb AS (SELECT mt.*, au.auc_roc FROM mt JOIN au USING (model))"""
LEADERBOARD = f"{SC}, {BOARD}"

LB_COLS = ("model, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, "
           "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score")

CELLS = f"""{conf_sql('ccf', 'sc', 'model, dataset')}, {metrics_sql('cmt', 'ccf', 'present_classes')},
{auc_sql('cau', 'sc', 'model, dataset')},
cw AS (SELECT m.model, m.dataset, accuracy, balanced_accuracy, precision, recall, f1_score,
              tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, a.auc_roc
       FROM cmt m JOIN cau a USING (model, dataset)),
cl AS (SELECT model, dataset, metric, value FROM (UNPIVOT (SELECT model, dataset, accuracy::DOUBLE AS accuracy,
          balanced_accuracy::DOUBLE AS balanced_accuracy, precision::DOUBLE AS precision, recall::DOUBLE AS recall,
          f1_score::DOUBLE AS f1_score, auc_roc::DOUBLE AS auc_roc, true_positives::DOUBLE AS true_positives,
          false_positives::DOUBLE AS false_positives, true_negatives::DOUBLE AS true_negatives,
          false_negatives::DOUBLE AS false_negatives FROM cw)
        ON accuracy, balanced_accuracy, precision, recall, f1_score, auc_roc, true_positives, false_positives,
           true_negatives, false_negatives INTO NAME metric VALUE value) WHERE value IS NOT NULL)"""
CROSS = f"{SC}, {CELLS}"

RATE = "('accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1_score', 'auc_roc')"

MODEL_NAMES = f"mn AS (SELECT doc_id, {C.FX.MODEL_NAME_SQL} AS model FROM documents)"

TERM_WEIGHTS = """tw AS (SELECT lang AS term, avg(ln(n_chars)) AS average, median(ln(n_chars)) AS median
         FROM documents GROUP BY lang
       UNION ALL SELECT source AS term, avg(ln(n_chars)), median(ln(n_chars)) FROM documents GROUP BY source)"""

ERR = f"""{SC},
er AS (SELECT doc_id AS id, y AS true_label, pred AS predicted_label, score AS hate_probability,
              (y = pred) AS correct_prediction,
              CASE WHEN score > 0.5 THEN score ELSE 1.0 - score END AS confidence,
              CASE WHEN pred = 1 AND y = 0 THEN 'False Positive' WHEN pred = 0 AND y = 1 THEN 'False Negative'
                   ELSE 'Correct' END AS error_type
       FROM sc WHERE model = '{C.SUBJECT_MODEL}')"""


def split_ctes(src: str, seed: str, frac: str, strata: str | None, name: str, id_col: str = "doc_id") -> str:
    part = f"PARTITION BY {strata}" if strata else ""
    u = U(f"'{seed}:' || CAST({id_col} AS VARCHAR)")
    return f"""{name} AS (SELECT s.*, CASE WHEN row_number() OVER ({part} ORDER BY {u}, {id_col}) - 1
          < round_even({frac}::DOUBLE * count(*) OVER ({part}), 0) THEN 'train' ELSE 'test' END AS split FROM {src} s)"""


H4CASES = f"""{split_ctes('fx_text', C.SEED + ':case', '0.05', None, 'hc0')},
hc_rest AS (SELECT doc_id, text, term, label FROM hc0 WHERE split = 'test'),
{split_ctes('hc_rest', C.SEED, '0.8', 'label', 'hc1')},
hc AS (SELECT doc_id, 'case' AS split FROM hc0 WHERE split = 'train' UNION ALL SELECT doc_id, split FROM hc1)"""


def f7_sql(src: str, need: str, cap: str, seed: str, name: str, prior: str = "0") -> str:
    """Copies j = 1..cap−prior of every row, ordered by (j, −ln(u)/w, id); first ``need`` per term."""
    u = U(f"'{seed}:' || CAST(vec_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)")
    return f"""{name}_cp AS (SELECT s.*, g.j FROM {src} s,
          LATERAL (SELECT unnest(range(1, {cap} - {prior} + 1)) AS j) g),
{name} AS (SELECT c.term, c.vec_id, c.j AS draw FROM {name}_cp c
  QUALIFY row_number() OVER (PARTITION BY c.term ORDER BY c.j,
          CASE WHEN c.sampling_weight > 0 THEN -ln({u}) / c.sampling_weight ELSE 'inf'::DOUBLE END, c.vec_id)
          <= {need})"""


def initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")


# ------------------------------------------------------------------ the statements
SQL: dict[str, str] = {}

# A
SQL["a1_read_term_tables"] = f"WITH {FX_TEXT_SQL} SELECT text, label, term FROM fx_text"
SQL["a2_resolve_text_column"] = "SELECT doc_id, text, lang FROM documents"
SQL["a3_validate_aligned"] = """SELECT
  sum(CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS matched,
  sum(CASE WHEN b.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_text,
  sum(CASE WHEN a.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_vectors, true AS term_defaulted
FROM documents a FULL OUTER JOIN labels b ON a.doc_id = b.doc_id"""
SQL["a4_embeddings_roundtrip"] = f"""WITH {FX_VEC_SQL} SELECT vec_id, term, len(v)::BIGINT AS dim,
  round(list_sum(v), 6) AS vsum FROM fx_vec"""
SQL["a5_read_weights_csv"] = f"""WITH {dens_ctes()} SELECT source_term AS model, round(avg(log_density), 6) AS weight
FROM dens WHERE k = {C.K} AND target_term = {T0} AND source_term <> {T0} GROUP BY source_term"""
SQL["a6_write_csv"] = f"""WITH {FX_DOCS_SQL} SELECT term, count(*)::BIGINT AS count,
  round(count(*) * 100.0 / (SELECT count(*) FROM fx_docs), 6) AS percent FROM fx_docs GROUP BY term"""
SQL["a7_metrics_json"] = f"""WITH {LEADERBOARD},
cd AS (SELECT model, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END)::BIGINT AS n_negative,
              sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS n_positive FROM sc GROUP BY model)
SELECT model, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1, round(auc_roc, 6) AS auc_roc,
  CASE WHEN n_negative > 0 THEN n_negative END AS n_negative, CASE WHEN n_positive > 0 THEN n_positive END AS n_positive
FROM lb JOIN cd USING (model)"""
SQL["a8_results_json_to_long"] = f"WITH {CROSS} SELECT model, dataset, metric, round(value, 6) AS value FROM cl"

# B
SQL["b1_project_rename"] = f"""WITH {FX_TEXT_SQL} SELECT text, term, CASE WHEN label = 'hate' THEN 1 ELSE 0 END AS label
FROM fx_text"""
SQL["b2_binarise_label"] = f"""WITH {FX_TEXT_SQL}
SELECT t.doc_id, CASE WHEN t.label = 'hate' THEN 1 ELSE 0 END AS label_exact,
  CASE WHEN TRY_CAST(upper(t.label) AS INTEGER) IS NOT NULL THEN TRY_CAST(upper(t.label) AS INTEGER)
       WHEN lower(upper(t.label)) = 'hate' THEN 1 ELSE 0 END AS label_lenient_upper,
  CASE WHEN CAST(l.toxic AS VARCHAR) = 'hate' THEN 1 ELSE 0 END AS int_exact,
  CASE WHEN TRY_CAST(CAST(l.toxic AS VARCHAR) AS INTEGER) IS NOT NULL THEN TRY_CAST(CAST(l.toxic AS VARCHAR) AS INTEGER)
       WHEN lower(CAST(l.toxic AS VARCHAR)) = 'hate' THEN 1 ELSE 0 END AS int_lenient
FROM fx_text t JOIN labels l ON t.doc_id = l.doc_id"""
SQL["b3a_filter_contains"] = "SELECT doc_id FROM documents WHERE coalesce(contains(lower(text), 'que'), false)"
SQL["b3b_filter_regex"] = "SELECT doc_id FROM documents WHERE coalesce(regexp_matches(text, '(?i)th[aeiou]u'), false)"
_det = " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in C.FX.DETECT_TERMS)
SQL["b4_detect_term"] = f"WITH {FX_DOCS_SQL} SELECT doc_id, CASE {_det} ELSE 'unknown' END AS detected_term FROM fx_docs"
SQL["b5_l2_normalise"] = f"""WITH {FX_VEC_SQL}, {NV_SQL} SELECT vec_id, round(list_sum(v), 6) AS nsum,
  round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM nv"""
SQL["b6_nan_to_num"] = f"""WITH {FX_VEC_SQL} SELECT vec_id,
  len(list_filter(v, lambda x: x > 0.2 OR x < -0.2)) > 0 AS has_non_finite,
  len(list_filter(v, lambda x: x > 0.2 OR x = 0))::BIGINT AS n_zero,
  len(list_filter(v, lambda x: x < -0.2))::BIGINT AS n_clamped FROM fx_vec"""
SQL["b7_log_sphere_volume"] = f"""WITH {FX_VEC_SQL} SELECT vec_id,
  round((64 / 2.0) * ln(pi()) + 64 * ln(abs(v[1]) + 0.5) - lgamma(64 / 2.0 + 1), 6) AS log_volume FROM fx_vec"""
SQL["b8_softmax_positive"] = f"""WITH {FX_LOGITS_SQL} SELECT vec_id, round(1.0 / (1.0 + exp(l0 - l1)), 6) AS score,
  CASE WHEN 1.0 / (1.0 + exp(l0 - l1)) >= 0.5 THEN 1 ELSE 0 END AS pred_threshold,
  CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred_argmax FROM fx_logits"""
SQL["b9_error_analysis"] = f"""WITH {ERR} SELECT id, correct_prediction, round(confidence, 6) AS confidence, error_type
FROM er"""
SQL["b10_density_weight"] = f"""WITH {dens_ctes()}, {D1ROWS},
st AS (SELECT min(log_density) AS mn, max(log_density) AS mx FROM d1)
SELECT vec_id AS qid, round(CASE WHEN mn = mx THEN 2.0 ELSE 0.1 + (log_density - mn) / (mx - mn) * 1.9 END, 6)
  AS density_weight FROM d1, st"""
SQL["b11_model_family"] = f"""WITH {MODEL_NAMES} SELECT doc_id, model,
  CASE WHEN contains(model, 'KNN') THEN 'KNN' WHEN contains(model, 'density') THEN 'Density'
       WHEN contains(model, 'majority') THEN 'Majority' ELSE 'Weighted' END AS family FROM mn"""
_PAT = r"^ModernBERT-k(\d+)(?:_balanced)?(?:-classifier|-final)$"
SQL["b12_parse_model_name"] = f"""WITH {MODEL_NAMES} SELECT doc_id,
  CAST(regexp_extract(model, '{_PAT}', 1) AS BIGINT) AS k, contains(model, '_balanced') AS balanced,
  contains(model, '-final') AS final,
  'KNN-k' || regexp_extract(model, '{_PAT}', 1) || CASE WHEN contains(model, '_balanced') THEN '-balanced' ELSE '' END
    AS display_name
FROM mn WHERE regexp_matches(model, '{_PAT}')"""
SQL["b13_percent_label"] = f"""WITH {SC}, {conf_sql('cf', 'sc', 'model')},
lg AS (UNPIVOT cf ON tn, fp, fn, tp INTO NAME cell VALUE count),
tot AS (SELECT model, sum(count) AS t FROM lg GROUP BY model)
SELECT model, cell, printf('%d', count) || chr(10) || printf('%.1f', count / t * 100.0) || '%' AS text
FROM lg JOIN tot USING (model)"""
SQL["b14_metric_display_name"] = f"""WITH {CROSS} SELECT model, dataset,
  {initcap("replace(metric, '_', ' ')")} AS display_name, round(value * 100.0, 6) AS value_pct
FROM cl WHERE metric = 'auc_roc'"""

# C
_C1 = f"""{FX_VEC_SQL}, {NV_SQL},
nb AS (SELECT q.vec_id AS qid, r.vec_id AS rid, power(list_distance(q.v, r.v), 2) AS distance
       FROM nv q JOIN nv r ON q.term <> {T0} AND r.term = {T0}),
nbr AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY distance, rid) - 1)::BIGINT AS rank FROM nb)"""
SQL["c1_knn_topk"] = f"WITH {_C1} SELECT qid, rank, rid, round(distance, 6) AS distance FROM nbr WHERE rank < 5"
SQL["c2_attach_neighbour_text"] = f"""WITH {_C1} SELECT n.qid, n.rank, n.rid, f.label FROM nbr n
JOIN fx_vec f ON f.vec_id = n.rid WHERE n.rank < 5"""
SQL["c3_align_by_key"] = f"""WITH {dens_ctes()}, {D1ROWS} SELECT vec_id, term, label, round(log_density, 6) AS log_density
FROM d1"""
SQL["c4_holdout_complement"] = f"""WITH {FX_DOCS_SQL}, {split_ctes('fx_docs', C.SEED, '0.8', None, 'sp')}
SELECT doc_id FROM sp WHERE split = 'test'"""
SQL["c5_models_with_weights"] = f"""WITH {TERM_WEIGHTS}, {FX_SCORES_SQL}
SELECT tw.term AS model, round(tw.average, 6) AS weight FROM tw WHERE tw.term IN (SELECT DISTINCT model FROM fx_scores)"""
SQL["c6_all_pairs"] = f"""WITH {CROSS},
ms AS (SELECT DISTINCT model FROM cl), ds AS (SELECT DISTINCT dataset FROM cl)
SELECT ms.model, ds.dataset, round(coalesce(c.value, 0.0), 6) AS value FROM ms CROSS JOIN ds
LEFT JOIN cl c ON c.model = ms.model AND c.dataset = ds.dataset AND c.metric = 'accuracy'"""
SQL["c7_restrict_to_top"] = f"""WITH {LEADERBOARD},
top AS (SELECT model FROM lb ORDER BY f1_score DESC, model LIMIT 2)
SELECT doc_id, model FROM fx_scores WHERE model IN (SELECT model FROM top)"""
SQL["c8_terms_without_model"] = """SELECT DISTINCT source AS term FROM documents WHERE source NOT IN
  (SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)"""

# D
SQL["d1_knn_log_density"] = f"""WITH {dens_ctes()}, {D1ROWS} SELECT vec_id, term, label, n_ref, k_used,
  round(kth_distance, 6) AS kth_distance, round(log_volume, 6) AS log_volume, round(log_density, 6) AS log_density
FROM d1"""
SQL["d2_knn_log_density_all"] = f"""WITH {dens_ctes()} SELECT qid, source_term, target_term, k, n_ref, k_used,
  round(kth_distance, 6) AS kth_distance, round(log_density, 6) AS log_density FROM dens"""
SQL["d2_knn_log_density_all_k1000"] = f"""WITH {dens_ctes((C.K_REFERENCE,))} SELECT qid, source_term, target_term, k,
  n_ref, k_used, round(kth_distance, 6) AS kth_distance, round(log_density, 6) AS log_density FROM dens"""
SQL["d3_term_density_matrix"] = f"""WITH {dens_ctes()}, {MATRIX}
SELECT source_term, target_term, round(avg_density, 6) AS avg_density FROM matrix"""
SQL["d4_term_density_to_target"] = f"""WITH {dens_ctes()} SELECT source_term AS term,
  round(avg(log_density), 6) AS average, round(median(log_density), 6) AS median
FROM dens WHERE k = {C.K} AND target_term = {T0} AND source_term <> {T0} GROUP BY source_term"""
SQL["d5_density_ratio"] = f"""WITH {dens_ctes()}, {RATIO} SELECT qid, term, round(density_to_target, 6) AS density_to_target,
  round(avg_density_to_others, 6) AS avg_density_to_others, round(log_density_ratio, 6) AS log_density_ratio FROM ratio2"""
SQL["d6_describe_values"] = f"""WITH {dens_ctes()}, {D1ROWS} SELECT count(log_density)::BIGINT AS n,
  round(min(log_density), 6) AS min, round(max(log_density), 6) AS max, round(avg(log_density), 6) AS mean,
  round(stddev_pop(log_density), 6) AS std_pop, round(stddev_samp(log_density), 6) AS std_samp,
  round(quantile_cont(log_density, 0.5), 6) AS median, round(quantile_cont(log_density, 0.0), 6) AS p0,
  round(quantile_cont(log_density, 0.25), 6) AS p25, round(quantile_cont(log_density, 0.5), 6) AS p50,
  round(quantile_cont(log_density, 0.75), 6) AS p75, round(quantile_cont(log_density, 1.0), 6) AS p100 FROM d1"""
SQL["d7_histogram"] = f"""WITH {dens_ctes()}, {D1ROWS},
mm AS (SELECT min(log_density) AS lo0, max(log_density) AS hi0 FROM d1),
mm2 AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
        FROM mm),
b AS (SELECT least(floor((log_density - lo) / (hi - lo) * 50.0) + 1, 50)::INTEGER AS bin FROM d1, mm2),
cnt AS (SELECT bin, count(*) AS c FROM b GROUP BY bin),
grid AS (SELECT range::INTEGER AS bin FROM range(1, 51))
SELECT grid.bin, round(lo + (grid.bin - 1) * ((hi - lo) / 50.0), 6) AS bin_lo,
  round(lo + grid.bin * ((hi - lo) / 50.0), 6) AS bin_hi, coalesce(cnt.c, 0)::BIGINT AS count
FROM grid CROSS JOIN mm2 LEFT JOIN cnt ON cnt.bin = grid.bin"""
_AB = f"""{FX_VEC_SQL}, a AS (SELECT vec_id, v FROM fx_vec WHERE term = {T0}),
b AS (SELECT vec_id, v FROM fx_vec WHERE term <> {T0})"""
SQL["d8_similarity_nn"] = f"""WITH {_AB},
m AS (SELECT b.vec_id, min(power(list_distance(a.v, b.v), 2)) AS d FROM b CROSS JOIN a GROUP BY b.vec_id)
SELECT round(avg(d), 6) AS similarity, count(*)::BIGINT AS n_b FROM m"""
SQL["d9_similarity_cosine"] = f"""WITH {FX_VEC_SQL}, {NV_SQL},
m AS (SELECT b.vec_id, max(list_inner_product(a.v, b.v)) AS c FROM nv b JOIN nv a ON a.term = {T0} AND b.term <> {T0}
      GROUP BY b.vec_id)
SELECT round(avg(c), 6) AS similarity, count(*)::BIGINT AS n_b FROM m"""
SQL["d10_selection_improves_similarity"] = f"""WITH {dens_ctes()}, {D1ROWS}, {E1SEL},
a AS (SELECT vec_id, v FROM fx_vec WHERE term = {T0}), b AS (SELECT vec_id, v FROM fx_vec WHERE term <> {T0}),
m AS (SELECT b.vec_id, min(power(list_distance(a.v, b.v), 2)) AS d FROM b CROSS JOIN a GROUP BY b.vec_id),
agg AS (SELECT avg(d) AS similarity_all, avg(CASE WHEN vec_id IN (SELECT vec_id FROM e1) THEN d END) AS similarity_selected
        FROM m)
SELECT round(similarity_all, 6) AS similarity_all, round(similarity_selected, 6) AS similarity_selected,
  similarity_selected < similarity_all AS improves FROM agg"""
SQL["d11_value_distribution"] = SQL["a6_write_csv"]
SQL["d12_crosstab"] = f"""WITH {FX_TEXT_SQL},
c AS (SELECT term, sum(CASE WHEN label = 'hate' THEN 1 ELSE 0 END)::BIGINT AS hate,
             sum(CASE WHEN label = 'no hate' THEN 1 ELSE 0 END)::BIGINT AS no_hate FROM fx_text GROUP BY term)
SELECT term, hate, no_hate, (hate + no_hate)::BIGINT AS total, round(hate * 100.0 / (hate + no_hate), 6) AS pct_hate,
  round(no_hate * 100.0 / (hate + no_hate), 6) AS pct_no_hate FROM c"""
_F7 = f"""{dens_ctes()}, {RATIO}, {WEIGHTS}, sz AS (SELECT term, count(*) AS n FROM wt GROUP BY term),
wt2 AS (SELECT wt.*, floor({C.F7_FACTOR}::DOUBLE * sz.n)::BIGINT AS need FROM wt JOIN sz USING (term)),
{f7_sql('wt2', 'need', str(C.F7_CAP), C.SEED, 'f7')}"""
SQL["d13_repetition_stats"] = f"""WITH {_F7}, reps AS (SELECT term, vec_id, count(*)::BIGINT AS repetitions FROM f7
  GROUP BY term, vec_id)
SELECT term, repetitions, count(*)::BIGINT AS num_samples FROM reps GROUP BY term, repetitions"""
SQL["d14_sorted_curve"] = f"""WITH {dens_ctes()}, {D1ROWS} SELECT vec_id AS qid, round(log_density, 6) AS log_density,
  (row_number() OVER (ORDER BY log_density, vec_id) - 1)::BIGINT AS position FROM d1"""

# E
SQL["e1_select_top_density"] = f"""WITH {dens_ctes()}, {D1ROWS}, {E1SEL}
SELECT vec_id, term, label, round(log_density, 6) AS log_density FROM e1"""
SQL["e2_select_top_balanced"] = f"""WITH {dens_ctes()}, {D1ROWS},
h AS (SELECT round_even(floor({C.TOP_FRACTION}::DOUBLE * count(*)) / 2.0, 0) AS half FROM d1)
SELECT vec_id, label, round(log_density, 6) AS log_density FROM d1, h
QUALIFY row_number() OVER (PARTITION BY label ORDER BY log_density DESC, vec_id) <= h.half"""
SQL["e3_select_top_indices"] = f"""WITH {dens_ctes()}, {D1ROWS},
p AS (SELECT * FROM d1 QUALIFY row_number() OVER (ORDER BY log_density DESC, vec_id DESC) <= 30)
SELECT vec_id, (row_number() OVER (ORDER BY log_density, vec_id) - 1)::BIGINT AS position,
  round(log_density, 6) AS log_density FROM p"""
SQL["e4_neighbour_rank"] = f"WITH {_C1} SELECT qid, rid, rank AS nrank FROM nbr WHERE rank < 5"
SQL["e5_most_certain"] = f"""WITH {ERR},
hi AS (SELECT 'certain' AS which, id, confidence FROM er ORDER BY confidence DESC, id LIMIT 20),
lo AS (SELECT 'uncertain' AS which, id, confidence FROM er ORDER BY confidence, id LIMIT 20)
SELECT which, id, round(confidence, 6) AS confidence FROM (SELECT * FROM hi UNION ALL SELECT * FROM lo)"""
SQL["e6_top_errors"] = f"""WITH {ERR},
fp AS (SELECT error_type, id, confidence FROM er WHERE error_type = 'False Positive' ORDER BY confidence DESC, id LIMIT 20),
fn AS (SELECT error_type, id, confidence FROM er WHERE error_type = 'False Negative' ORDER BY confidence DESC, id LIMIT 20)
SELECT error_type, id, round(confidence, 6) AS confidence FROM (SELECT * FROM fp UNION ALL SELECT * FROM fn)"""
SQL["e7_top_pairs"] = f"""WITH {dens_ctes()}, {MATRIX}
SELECT source_term, target_term, round(avg_density, 6) AS avg_density FROM matrix WHERE source_term <> target_term
ORDER BY avg_density DESC, source_term, target_term LIMIT 5"""
SQL["e8_top_models"] = f"""WITH {LEADERBOARD} SELECT model, round(f1_score, 6) AS f1_score FROM lb
ORDER BY f1_score DESC, model LIMIT 5"""
SQL["e9_best_model"] = f"""WITH {LEADERBOARD},
a AS (SELECT 'balanced_accuracy' AS metric, model AS best_model, balanced_accuracy AS best_value FROM lb
      ORDER BY balanced_accuracy DESC, model LIMIT 1),
b AS (SELECT 'auc_roc' AS metric, model AS best_model, auc_roc AS best_value FROM lb ORDER BY auc_roc DESC, model LIMIT 1)
SELECT metric, best_model, round(best_value, 6) AS best_value FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
SQL["e10_model_rank"] = f"""WITH {LEADERBOARD} SELECT model,
  row_number() OVER (ORDER BY balanced_accuracy DESC, model)::BIGINT AS rank FROM lb"""
SQL["e11_parameter_sweep"] = f"""WITH {dens_ctes(C.SWEEP_KS)},
sw AS (SELECT d.qid, d.k, d.log_density, f.label FROM dens d JOIN fx_vec f ON f.vec_id = d.qid
       WHERE d.target_term = {T0} AND d.source_term <> {T0}),
n AS (SELECT k, floor({C.TOP_FRACTION}::DOUBLE * count(*))::BIGINT AS n FROM sw GROUP BY k),
plain AS (SELECT sw.k, false AS balanced, sw.qid FROM sw JOIN n USING (k)
          QUALIFY row_number() OVER (PARTITION BY sw.k ORDER BY log_density DESC, qid) <= n.n),
bal AS (SELECT sw.k, true AS balanced, sw.qid FROM sw JOIN n USING (k)
        QUALIFY row_number() OVER (PARTITION BY sw.k, label ORDER BY log_density DESC, qid) <= round_even(n.n / 2.0, 0))
SELECT k, balanced, qid FROM plain UNION ALL SELECT k, balanced, qid FROM bal"""

# F
SQL["f1_union_terms"] = f"""WITH {FX_DOCS_SQL},
s AS (SELECT doc_id, term, dense_rank() OVER (ORDER BY term) AS src FROM fx_docs WHERE term IS NOT NULL)
SELECT (row_number() OVER (ORDER BY src, doc_id) - 1)::BIGINT AS row_id, doc_id, term FROM s"""
SQL["f2_stratified_split"] = f"""WITH {FX_TEXT_SQL}, {split_ctes('fx_text', C.SEED, '0.8', 'label', 'sp')}
SELECT doc_id, split FROM sp"""
SQL["f3_random_split"] = f"""WITH {FX_DOCS_SQL}, {split_ctes('fx_docs', C.SEED, '0.8', None, 'sp')}
SELECT doc_id, split FROM sp"""
SQL["f4_holdout_cases"] = f"WITH {FX_TEXT_SQL}, {H4CASES} SELECT doc_id, split FROM hc"
SQL["f5_shuffle"] = f"""WITH {FX_DOCS_SQL} SELECT doc_id,
  (row_number() OVER (ORDER BY {U(chr(39) + C.SEED + ':' + chr(39) + ' || CAST(doc_id AS VARCHAR)')}, doc_id) - 1)::BIGINT
  AS position FROM fx_docs"""
SQL["f6_cap_sample"] = f"""SELECT doc_id FROM documents
QUALIFY (SELECT count(*) FROM documents) <= 500 OR row_number() OVER
  (ORDER BY {U(chr(39) + C.SEED + ':' + chr(39) + ' || CAST(doc_id AS VARCHAR)')}, doc_id) <= 500"""
SQL["f7_weighted_sample_capped"] = f"WITH {_F7} SELECT term, vec_id, draw::BIGINT AS draw FROM f7"
SQL["f8_sampling_weight"] = f"""WITH {dens_ctes()}, {RATIO}, {WEIGHTS}
SELECT vec_id, term, round(sampling_weight, 6) AS sampling_weight FROM wt"""
SQL["f9_term_quota"] = f"""WITH {dens_ctes()}, {RATIO},
mr AS (SELECT term, avg(log_density_ratio) AS mean_ratio FROM ratio2 GROUP BY term),
p AS (SELECT count(*) AS t, CASE WHEN {C.F9_TOTAL} - {C.F9_MIN} * count(*) < 0 THEN {C.F9_TOTAL} // count(*)
             ELSE {C.F9_MIN} END AS min_q FROM mr),
q AS (SELECT mr.term, p.min_q, mr.mean_ratio / sum(mr.mean_ratio) OVER () AS term_weight,
             ({C.F9_TOTAL} - p.min_q * p.t)::DOUBLE AS remaining FROM mr, p)
SELECT term, min_q::BIGINT AS min_quota, round(term_weight, 6) AS term_weight,
  greatest(trunc(remaining * term_weight), 0)::BIGINT AS additional FROM q"""
SQL["f10_repeat_small_term"] = f"""WITH {FX_VEC_SQL},
cp AS (SELECT f.term, f.vec_id, g.j AS draw FROM fx_vec f, LATERAL (SELECT unnest(range(1, 4)) AS j) g)
SELECT term, vec_id, draw::BIGINT AS draw FROM cp
QUALIFY row_number() OVER (PARTITION BY term ORDER BY draw, vec_id) <= 100"""
_CAP = C.F11_CAP
SQL["f11_balanced_resample"] = f"""WITH {dens_ctes()}, {RATIO},
rows0 AS (SELECT vec_id, term, label FROM fx_vec WHERE term <> {T0}),
base AS (SELECT r.vec_id, r.term, x.log_density_ratio FROM rows0 r JOIN ratio2 x ON x.qid = r.vec_id),
bw AS (SELECT *, exp(log_density_ratio - max(log_density_ratio) OVER (PARTITION BY term)) AS sampling_weight FROM base),
sz AS (SELECT term, count(*) AS n, avg(log_density_ratio) AS mr FROM bw GROUP BY term),
p AS (SELECT count(*) AS t, CASE WHEN {C.F11_TOTAL} - {C.F11_MIN} * count(*) < 0 THEN {C.F11_TOTAL} // count(*)
             ELSE {C.F11_MIN} END AS min_q FROM sz),
quota AS (SELECT sz.term, sz.n, p.min_q, greatest(trunc(({C.F11_TOTAL} - p.min_q * p.t)::DOUBLE *
                 (sz.mr / sum(sz.mr) OVER ())), 0)::BIGINT AS additional,
                 sz.n < p.min_q / {float(_CAP)} AS small FROM sz, p),
p1s AS (SELECT b.term, b.vec_id, g.j AS draw FROM bw b JOIN quota q USING (term),
               LATERAL (SELECT unnest(range(1, {_CAP} + 1)) AS j) g WHERE q.small
        QUALIFY row_number() OVER (PARTITION BY b.term ORDER BY g.j, b.vec_id) <= q.min_q),
big AS (SELECT b.*, q.min_q AS need FROM bw b JOIN quota q USING (term) WHERE NOT q.small AND q.min_q > 0),
{f7_sql('big', 'need', str(_CAP), C.SEED + ':min', 'p1b')},
prior AS (SELECT term, vec_id, count(*) AS prior FROM p1b GROUP BY term, vec_id
          UNION ALL SELECT b.term, b.vec_id, least({_CAP}, floor(q.min_q / q.n) + 1)::BIGINT AS prior
          FROM bw b JOIN quota q USING (term) WHERE q.small),
src2 AS (SELECT b.*, coalesce(pr.prior, 0)::BIGINT AS prior, q.additional AS need FROM bw b JOIN quota q USING (term)
         LEFT JOIN prior pr ON pr.term = b.term AND pr.vec_id = b.vec_id
         WHERE q.additional > 0 AND {_CAP} - coalesce(pr.prior, 0) > 0),
p2_cp AS (SELECT s.term, s.vec_id, s.sampling_weight, s.need, g.j FROM src2 s,
          LATERAL (SELECT unnest(range(1, {_CAP} - s.prior + 1)) AS j) g),
p2 AS (SELECT c.term, c.vec_id, c.j AS draw FROM p2_cp c
  QUALIFY row_number() OVER (PARTITION BY c.term ORDER BY c.j,
          CASE WHEN c.sampling_weight > 0 THEN -ln({U(chr(39) + C.SEED + ':add:' + chr(39) + " || CAST(c.vec_id AS VARCHAR) || ':' || CAST(c.j AS VARCHAR)")}) / c.sampling_weight
               ELSE 'inf'::DOUBLE END, c.vec_id) <= c.need),
allp AS (SELECT term, vec_id, 1 AS phase, draw FROM p1s UNION ALL SELECT term, vec_id, 1, draw FROM p1b
         UNION ALL SELECT term, vec_id, 2, draw FROM p2),
keyed AS (SELECT *, CAST(phase AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR) || ':' || CAST(draw AS VARCHAR) AS sk FROM allp)
SELECT term, vec_id, phase::BIGINT AS phase, draw::BIGINT AS draw,
  (row_number() OVER (ORDER BY {U(chr(39) + C.SEED + ':shuffle:' + chr(39) + ' || sk')}, sk) - 1)::BIGINT AS position
FROM keyed"""

# G
SQL["g1_normalise_weights"] = f"""WITH {TERM_WEIGHTS} SELECT term AS model,
  round(average / (SELECT sum(average) FROM tw), 6) AS weight FROM tw"""
SQL["g2_majority_vote"] = f"""WITH {FX_SCORES_SQL},
g AS (SELECT doc_id, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS votes, count(*)::BIGINT AS n_models
      FROM fx_scores GROUP BY doc_id)
SELECT doc_id, votes, n_models, CASE WHEN votes > n_models / 2.0 THEN 'hate' ELSE 'no hate' END AS prediction,
  round(votes::DOUBLE / n_models, 6) AS confidence FROM g"""
SQL["g3_weighted_average"] = f"""WITH {FX_SCORES_SQL},
w AS (SELECT model, 1.0 / (SELECT count(DISTINCT model) FROM fx_scores) AS weight FROM (SELECT DISTINCT model FROM fx_scores)),
g AS (SELECT s.doc_id, sum(w.weight * s.score) AS ws FROM fx_scores s JOIN w USING (model) GROUP BY s.doc_id)
SELECT doc_id, round(ws, 6) AS weighted_score, CASE WHEN ws >= 0.5 THEN 'hate' ELSE 'no hate' END AS prediction,
  round(greatest(ws, 1.0 - ws), 6) AS confidence FROM g"""
SQL["g4_density_weighted"] = f"""WITH {TERM_WEIGHTS}, {FX_SCORES_SQL},
kept AS (SELECT term AS model, average AS weight FROM tw WHERE term IN (SELECT DISTINCT model FROM fx_scores)),
w AS (SELECT model, weight / (SELECT sum(weight) FROM kept) AS weight FROM kept),
g AS (SELECT s.doc_id, sum(w.weight * s.score) AS ws FROM fx_scores s JOIN w USING (model) GROUP BY s.doc_id)
SELECT doc_id, round(ws, 6) AS weighted_score, CASE WHEN ws >= 0.5 THEN 'hate' ELSE 'no hate' END AS prediction,
  round(ws, 6) AS confidence FROM g"""
SQL["g5_score_models_on_datasets"] = f"""WITH {FX_SCORES_SQL}
SELECT s.doc_id, s.model, round(s.score, 6) AS score, t.term AS dataset, t.label,
  CASE WHEN s.score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM fx_scores s JOIN fx_text t ON t.doc_id = s.doc_id"""

# H
SQL["h1_confusion"] = f"WITH {SC}, {conf_sql('cf', 'sc', 'model')} SELECT * FROM cf"
SQL["h2_confusion_normalised"] = f"""WITH {SC}, {conf_sql('cf', 'sc', 'model')}
SELECT model, tn, fp, fn, tp,
  round(CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0.0 END, 6) AS tn_norm,
  round(CASE WHEN tn + fp > 0 THEN fp::DOUBLE / (tn + fp) ELSE 0.0 END, 6) AS fp_norm,
  round(CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) ELSE 0.0 END, 6) AS fn_norm,
  round(CASE WHEN fn + tp > 0 THEN tp::DOUBLE / (fn + tp) ELSE 0.0 END, 6) AS tp_norm FROM cf"""
SQL["h3_binary_metrics"] = f"WITH {SC}, {conf_sql('cf', 'sc', 'model')}, {metrics_sql('mt', 'cf')} SELECT {LB_COLS} FROM mt"
SQL["h4_auc_roc"] = f"""WITH {SC}, {auc_sql('au', 'sc', 'model, dataset')}
SELECT model, dataset, round(auc_roc, 6) AS auc_roc FROM au"""
SQL["h5_weighted_f1"] = f"""WITH {SC}, {conf_sql('cf', 'sc', 'model')}
SELECT model, round(CASE WHEN tn + fp + fn + tp > 0 THEN
  ((CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) * (tp + fn) +
   (CASE WHEN 2 * tn + fn + fp > 0 THEN 2.0 * tn / (2 * tn + fn + fp) ELSE 0.0 END) * (tn + fp)) / (tn + fp + fn + tp)
  END, 6) AS weighted_f1 FROM cf"""
SQL["h6_class_distribution"] = f"""WITH {FX_TEXT_SQL} SELECT CASE WHEN label = 'hate' THEN 1 ELSE 0 END AS y,
  count(*)::BIGINT AS count FROM fx_text GROUP BY 1"""
SQL["h7_mft_failure_rate"] = f"""WITH {SC}, {H4CASES}
SELECT model, count(*)::BIGINT AS cases, sum(CASE WHEN pred <> y THEN 1 ELSE 0 END)::BIGINT AS fails,
  round(sum(CASE WHEN pred <> y THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS failure_rate
FROM sc WHERE doc_id IN (SELECT doc_id FROM hc WHERE split = 'case') GROUP BY model"""
SQL["h8_density_weighted_log_loss"] = f"""WITH {dens_ctes()}, {D1ROWS}, {FX_LOGITS_SQL},
st AS (SELECT min(log_density) AS mn, max(log_density) AS mx FROM d1),
w AS (SELECT vec_id, CASE WHEN label = 'hate' THEN 1 ELSE 0 END AS y,
             CASE WHEN mn = mx THEN 2.0 ELSE 0.1 + (log_density - mn) / (mx - mn) * 1.9 END AS density_weight FROM d1, st),
t AS (SELECT w.density_weight, w.y, l.l0, l.l1, greatest(l.l0, l.l1) AS m FROM w JOIN fx_logits l USING (vec_id))
SELECT round(avg(density_weight * (m + ln(exp(l0 - m) + exp(l1 - m)) - CASE WHEN y = 1 THEN l1 ELSE l0 END)), 6)
  AS log_loss FROM t"""
SQL["h9_model_leaderboard"] = f"WITH {LEADERBOARD} SELECT {LB_COLS}, round(auc_roc, 6) AS auc_roc FROM lb"
SQL["h10_count_by_family"] = f"""WITH {MODEL_NAMES}, d AS (SELECT DISTINCT model FROM mn)
SELECT CASE WHEN contains(model, 'KNN') THEN 'KNN' WHEN contains(model, 'density') THEN 'Density'
       WHEN contains(model, 'majority') THEN 'Majority' ELSE 'Weighted' END AS family, count(*)::BIGINT AS n_models
FROM d GROUP BY 1"""
SQL["h11_ensemble_comparison"] = f"""WITH {LEADERBOARD},
mv0 AS (SELECT doc_id, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS votes, count(*) AS n FROM fx_scores GROUP BY doc_id),
mvs AS (SELECT 'majority_ensemble' AS model, CASE WHEN t.label = 'hate' THEN 1 ELSE 0 END AS y,
               CASE WHEN votes > n / 2.0 THEN 1 ELSE 0 END AS pred, votes::DOUBLE / n AS score
        FROM mv0 JOIN fx_text t USING (doc_id)),
{conf_sql('mcf', 'mvs', 'model')}, {metrics_sql('mmt', 'mcf')}, {auc_sql('mau', 'mvs', 'model')},
new AS (SELECT mmt.*, mau.auc_roc FROM mmt JOIN mau USING (model)),
both_ AS (SELECT model, accuracy, balanced_accuracy, f1_score, auc_roc FROM lb
          UNION ALL SELECT model, accuracy, balanced_accuracy, f1_score, auc_roc FROM new)
SELECT model, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
  round(f1_score, 6) AS f1_score, round(auc_roc, 6) AS auc_roc FROM both_"""
_MELT = """(UNPIVOT (SELECT model, accuracy, balanced_accuracy, precision, recall, f1_score, auc_roc FROM lb)
  ON accuracy, balanced_accuracy, precision, recall, f1_score, auc_roc INTO NAME metric VALUE score)"""


def improvement_sql(long: str, keys: str, subject: str) -> str:
    k = f"{keys}, metric" if keys else "metric"
    j = " AND ".join(f"s.{c.strip()} = b.{c.strip()}" for c in k.split(","))
    return f"""oth AS (SELECT {k}, model, score FROM {long} WHERE model <> '{subject}'),
best AS (SELECT {k}, max(score) AS mx, arg_min(model, (-score, model)) AS bm FROM oth GROUP BY {k}),
subj AS (SELECT {k}, score AS subject_value FROM {long} WHERE model = '{subject}'),
imp AS (SELECT s.*, CASE WHEN coalesce(b.mx, 0) > 0 THEN b.bm ELSE '' END AS best_other_model,
               CASE WHEN coalesce(b.mx, 0) > 0 THEN b.mx ELSE 0.0 END AS best_other_value,
               CASE WHEN coalesce(b.mx, 0) > 0 THEN (s.subject_value - b.mx) / b.mx * 100.0 ELSE 0.0 END AS improvement
        FROM subj s LEFT JOIN best b ON {j})"""


SQL["h12_improvement_vs_best_other"] = f"""WITH {LEADERBOARD}, lg AS (SELECT * FROM {_MELT}),
{improvement_sql('lg', '', C.SUBJECT_MODEL)}
SELECT metric, round(subject_value, 6) AS subject_value, best_other_model, round(best_other_value, 6) AS best_other_value,
  round(improvement, 6) AS improvement FROM imp"""
_TERMM = f"""{SC},
st AS (SELECT sc.*, CASE {_det.replace('lower(text)', 'lower(t.text)')} ELSE 'unknown' END AS detected_term
       FROM sc JOIN fx_text t USING (doc_id)),
st2 AS (SELECT * FROM st WHERE detected_term <> 'unknown'),
{conf_sql('tcf', 'st2', 'detected_term, model')}, {metrics_sql('tmt', 'tcf', 'present_classes')},
tm AS (SELECT *, (tn + fp + fn + tp)::BIGINT AS samples FROM tmt WHERE tn + fp + fn + tp > 5)"""
SQL["h13_metrics_by_detected_term"] = f"""WITH {_TERMM} SELECT detected_term, model, round(accuracy, 6) AS accuracy,
  round(balanced_accuracy, 6) AS balanced_accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, samples FROM tm"""
_TLONG = """tl AS (SELECT * FROM (UNPIVOT (SELECT detected_term, model, accuracy, balanced_accuracy, precision, recall,
  f1_score FROM tm) ON accuracy, balanced_accuracy, precision, recall, f1_score INTO NAME metric VALUE score))"""
_H14 = f"""{_TERMM}, {_TLONG}, {improvement_sql('tl', 'detected_term', C.SUBJECT_MODEL)},
imp2 AS (SELECT imp.*, tm.samples FROM imp JOIN tm ON tm.detected_term = imp.detected_term AND tm.model = '{C.SUBJECT_MODEL}')"""
SQL["h14_improvement_by_term"] = f"""WITH {_H14} SELECT detected_term, metric, round(subject_value, 6) AS subject_value,
  best_other_model, round(best_other_value, 6) AS best_other_value, round(improvement, 6) AS improvement, samples FROM imp2"""
SQL["h15_improvement_rollups"] = f"""WITH {_H14}
SELECT CASE GROUPING(detected_term, metric) WHEN 0 THEN 'term_metric' WHEN 1 THEN 'term' WHEN 2 THEN 'metric'
       ELSE 'all' END AS level, detected_term, metric, round(avg(improvement), 6) AS mean_improvement,
  sum(CASE WHEN improvement > 0 THEN 1 ELSE 0 END)::BIGINT AS n_better
FROM imp2 GROUP BY CUBE (detected_term, metric)"""
SQL["h16_melt_metrics"] = f"WITH {LEADERBOARD} SELECT model, metric, round(score, 6) AS score FROM {_MELT}"

# I
SQL["i1_cross_term_metrics"] = f"""WITH {CROSS} SELECT model, dataset, round(accuracy, 6) AS accuracy,
  round(balanced_accuracy, 6) AS balanced_accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, true_positives, false_positives, true_negatives, false_negatives,
  round(auc_roc, 6) AS auc_roc FROM cw"""
SQL["i2_metric_matrix"] = f"""WITH {CROSS}, ms AS (SELECT DISTINCT model FROM cl)
SELECT a.model, b.model AS dataset, round(c.value * 100.0, 6) AS value FROM ms a CROSS JOIN ms b
LEFT JOIN cl c ON c.model = a.model AND c.dataset = b.model AND c.metric = 'auc_roc'"""
SQL["i3_available_metrics"] = f"""WITH {CROSS}, cells AS (SELECT count(*) AS n FROM (SELECT DISTINCT model, dataset FROM cl))
SELECT metric, count(DISTINCT (model, dataset))::BIGINT AS n_cells,
  count(DISTINCT (model, dataset)) = (SELECT n FROM cells) AS complete
FROM cl WHERE metric NOT IN ('true_positives', 'false_positives', 'true_negatives', 'false_negatives') GROUP BY metric"""
SQL["i4_availability_matrix"] = f"""WITH {CROSS}, ms AS (SELECT DISTINCT model FROM cl), ds AS (SELECT DISTINCT dataset FROM cl),
fm AS (SELECT min(metric) AS m FROM cl WHERE metric NOT IN ('true_positives', 'false_positives', 'true_negatives',
       'false_negatives'))
SELECT ms.model, ds.dataset, (CASE WHEN EXISTS (SELECT 1 FROM cl, fm WHERE cl.model = ms.model AND cl.dataset = ds.dataset
  AND cl.metric = fm.m) THEN 1 ELSE 0 END)::BIGINT AS available FROM ms CROSS JOIN ds"""
SQL["i5_mean_metric_per_model"] = f"""WITH {CROSS}, ms AS (SELECT DISTINCT model FROM cl),
mt AS (SELECT unnest(['accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1_score', 'auc_roc']) AS metric),
g AS (SELECT model, metric, avg(value) AS v FROM cl WHERE metric IN {RATE} GROUP BY model, metric)
SELECT ms.model, mt.metric, round(coalesce(g.v, 0.0), 6) AS mean_value FROM ms CROSS JOIN mt
LEFT JOIN g ON g.model = ms.model AND g.metric = mt.metric"""
SQL["i6_in_out_domain_averages"] = f"""WITH {CROSS}, t AS (SELECT * FROM cl WHERE metric IN {RATE}),
dg AS (SELECT metric, avg(value) AS in_domain FROM t WHERE model = dataset GROUP BY metric),
pm AS (SELECT metric, model, avg(value) AS m FROM t WHERE model <> dataset GROUP BY metric, model),
od AS (SELECT metric, avg(m) AS out_domain FROM pm GROUP BY metric)
SELECT coalesce(dg.metric, od.metric) AS metric, round(in_domain, 6) AS in_domain, round(out_domain, 6) AS out_domain
FROM dg FULL OUTER JOIN od ON dg.metric = od.metric"""
SQL["i7_cross_term_summary"] = f"""WITH {CROSS}, t AS (SELECT * FROM cl WHERE metric IN {RATE}),
g AS (SELECT model, metric, max(CASE WHEN model = dataset THEN value END) AS in_domain,
             avg(CASE WHEN model <> dataset THEN value END) AS out_domain FROM t GROUP BY model, metric)
SELECT model, metric, round(in_domain, 6) AS in_domain, round(out_domain, 6) AS out_domain,
  round(in_domain - out_domain, 6) AS drop FROM g"""

# J (the deterministic ones have a SQL statement; trained/projected outputs are row-checked)


def tfidf_sql(src: str) -> str:
    """CTEs up to ``tv``: (doc_id, idx, x), the sparse TF-IDF vectors of ``src`` (doc_id, text)."""
    word = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"
    return f"""tw AS (SELECT doc_id, unnest({word}) AS w FROM {src}),
tc AS (SELECT doc_id, ('0x'||substr(md5(w),1,8))::BIGINT % {C.J_FEATURES} AS idx, count(*) AS n FROM tw WHERE w <> '' GROUP BY 1, 2),
ti AS (SELECT idx, ln(((SELECT count(*) FROM {src}) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM tc GROUP BY idx),
tx AS (SELECT doc_id, idx, n * idf AS x FROM tc JOIN ti USING (idx)),
tn AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM tx GROUP BY doc_id),
tv AS MATERIALIZED (SELECT doc_id, idx::BIGINT AS idx, CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END AS x FROM tx JOIN tn USING (doc_id))"""


def logistic_sql(group: str, weight: str) -> str:
    """CTEs up to ``lm``: (model, idx, w), fitted on ``lr`` (doc_id, y, ...); the bias has the index J_FEATURES."""
    ctes = [f"""lz AS (SELECT {group} AS model, sum({weight}) AS total FROM lr GROUP BY 1),
lf AS MATERIALIZED (SELECT lr.doc_id, {group} AS model, y, {weight} AS sw, idx, x FROM lr JOIN
  (SELECT * FROM tv UNION ALL SELECT doc_id, {C.J_FEATURES}, 1.0 FROM lr) v USING (doc_id)),
l0 AS MATERIALIZED (SELECT DISTINCT model, idx, 0.0::DOUBLE AS w, 0.0::DOUBLE AS a FROM lf)"""]
    for i in range(C.ML.ITERATIONS):
        ctes.append(f"""m{i} AS MATERIALIZED (SELECT doc_id, model, any_value(sw) * (1.0 / (1.0 + exp(-sum(x * a))) - any_value(y)) AS e
  FROM lf JOIN l{i} USING (model, idx) GROUP BY 1, 2),
g{i} AS MATERIALIZED (SELECT model, idx, sum(e * x) AS g FROM lf JOIN m{i} USING (doc_id, model) GROUP BY 1, 2),
n{i} AS MATERIALIZED (SELECT model, idx, w, a - {C.ML.STEP!r}::DOUBLE * (g / total + CASE WHEN idx < {C.J_FEATURES} THEN {C.ML.RIDGE} * a ELSE 0.0 END) AS b
  FROM l{i} JOIN g{i} USING (model, idx) JOIN lz USING (model)),
l{i + 1} AS MATERIALIZED (SELECT model, idx, b AS w, b + {C.ML.MOMENTUM!r}::DOUBLE * (b - w) AS a FROM n{i})""")
    return ",\n".join(ctes) + f",\nlm AS MATERIALIZED (SELECT model, idx, w FROM l{C.ML.ITERATIONS})"


J_TEXT = f"""{FX_TEXT_SQL}, {tfidf_sql('fx_text')},
lt AS (SELECT doc_id, term, CASE WHEN label = 'hate' THEN 1.0 ELSE 0.0 END AS y FROM fx_text)"""
J3_SCORES = f"""{J_TEXT}, lr AS (SELECT * FROM lt WHERE term IN (SELECT term FROM lt GROUP BY term HAVING min(y) < max(y))),
{logistic_sql('term', '1.0')},
j3 AS (SELECT d.doc_id, d.model, 1.0 / (1.0 + exp(-(d.bias + coalesce(s.m, 0.0)))) AS score
  FROM (SELECT doc_id, model, w AS bias FROM lt, lm WHERE idx = {C.J_FEATURES}) d
  LEFT JOIN (SELECT doc_id, model, sum(x * w) AS m FROM tv JOIN lm USING (idx) GROUP BY 1, 2) s USING (doc_id, model))"""
SQL["j1_embed_text"] = f"WITH {tfidf_sql('documents')} SELECT doc_id, idx AS index, round(x, 6) AS weight FROM tv"
SQL["j3_fit_term_classifiers"] = f"WITH {J3_SCORES} SELECT doc_id, model, round(score, 6) AS score FROM j3"
SQL["j3_saved_models"] = SQL["j3_fit_term_classifiers"]
SQL["j2_score_text_trained"] = f"""WITH {J3_SCORES} SELECT doc_id, model, CASE WHEN score >= 0.5 THEN 'hate' ELSE 'no hate' END AS prediction,
  round(score, 6) AS score FROM j3 WHERE model = '{C.FX.MODELS[0]}'"""
SQL["j1_embed_text_with"] = """SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::BIGINT AS n_e,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::BIGINT AS n_space FROM documents"""
SQL["j3_cross_term_summary"] = f"""WITH {J3_SCORES}, {TERM_WEIGHTS.replace('tw AS', 'dw AS')},
kept AS (SELECT term AS model, average AS weight FROM dw WHERE term IN (SELECT DISTINCT model FROM j3)),
ew AS (SELECT model, weight / (SELECT sum(weight) FROM kept) AS weight FROM kept),
ja AS (SELECT doc_id, model, score FROM j3 UNION ALL
  SELECT doc_id, 'ensemble', sum(weight * score) FROM j3 JOIN ew USING (model) GROUP BY doc_id),
sc AS MATERIALIZED (SELECT ja.doc_id, ja.model, term AS dataset, y::INTEGER AS y, round(score, 6) AS score,
  CASE WHEN round(score, 6) >= 0.5 THEN 1 ELSE 0 END AS pred FROM ja JOIN lt USING (doc_id)),
{CELLS}, {BOARD}, t AS (SELECT * FROM cl WHERE metric IN {RATE}),
sg AS (SELECT model, metric, max(CASE WHEN model = dataset THEN value END) AS in_domain,
             avg(CASE WHEN model <> dataset THEN value END) AS out_domain FROM t GROUP BY model, metric),
ov AS (UNPIVOT (SELECT model, accuracy::DOUBLE AS accuracy, balanced_accuracy::DOUBLE AS balanced_accuracy, precision::DOUBLE AS precision,
  recall::DOUBLE AS recall, f1_score::DOUBLE AS f1_score, auc_roc::DOUBLE AS auc_roc FROM lb)
  ON accuracy, balanced_accuracy, precision, recall, f1_score, auc_roc INTO NAME metric VALUE overall)
SELECT model, metric, round(in_domain, 6) AS in_domain, round(out_domain, 6) AS out_domain,
  round(in_domain - out_domain, 6) AS drop, round(overall, 6) AS overall FROM sg JOIN ov USING (model, metric)"""
SQL["j4_fit_density_weighted"] = f"""WITH {J_TEXT}, ld AS (SELECT lt.*, ln(n_chars) AS d FROM lt JOIN documents USING (doc_id)),
lr AS (SELECT doc_id, y, CASE WHEN lo = hi THEN 2.0 ELSE 0.1 + (d - lo) / (hi - lo) * 1.9 END AS sw
  FROM ld, (SELECT min(d) AS lo, max(d) AS hi FROM ld)), {logistic_sql('0', 'sw')}
SELECT doc_id, round(1.0 / (1.0 + exp(-(b.w + coalesce(m, 0.0)))), 6) AS score FROM lr JOIN (SELECT w FROM lm WHERE idx = {C.J_FEATURES}) b ON true
LEFT JOIN (SELECT doc_id, sum(x * w) AS m FROM tv JOIN lm USING (idx) GROUP BY 1) USING (doc_id)"""
_mv = "list_transform(c, lambda r: list_inner_product(r, {q}))"
_unit = "list_transform({z}, lambda x: x / sqrt(list_inner_product({z}, {z})))"
_sign = "list_transform({q}, lambda x: x * (CASE WHEN {q}[list_position(list_transform({q}, lambda y: abs(y)), list_max(list_transform({q}, lambda y: abs(y))))] < 0 THEN -1 ELSE 1 END))"
PCA_SQL = f"""px AS (SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM fx_vec),
pm AS (SELECT i, avg(x) AS m FROM px GROUP BY i),
pc AS MATERIALIZED (SELECT vec_id, i, x - m AS x FROM px JOIN pm USING (i)),
pv AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM fx_vec) - 1) AS s FROM pc a JOIN pc b USING (vec_id) GROUP BY 1, 2),
pr AS MATERIALIZED (SELECT list(r ORDER BY i) AS c, count(*) AS d FROM (SELECT i, list(s ORDER BY j) AS r FROM pv GROUP BY i)),
pq(n, q1, q2) AS (SELECT 0, list_transform(range(0, d), lambda i: 1.0::DOUBLE), list_transform(range(0, d), lambda i: cos(pi() * (i + 0.5::DOUBLE) / d)) FROM pr
  UNION ALL SELECT n + 1, u1, {_unit.format(z='o2')} FROM (SELECT n, u1, list_transform(list_zip(z2, u1), lambda p: p[1] - h * p[2]) AS o2 FROM
    (SELECT n, u1, z2, list_inner_product(u1, z2) AS h FROM (SELECT n, {_unit.format(z='z1')} AS u1, z2 FROM
      (SELECT n, {_mv.format(q='q1')} AS z1, {_mv.format(q='q2')} AS z2 FROM pq, pr WHERE n < {C.ML.POWER_STEPS}))))),
pe AS MATERIALIZED (SELECT {_sign.format(q='q1')} AS q1, {_sign.format(q='q2')} AS q2 FROM pq WHERE n = {C.ML.POWER_STEPS}),
pp AS MATERIALIZED (SELECT vec_id, sum(x * q1[i]) AS pc1, sum(x * q2[i]) AS pc2 FROM pc, pe GROUP BY vec_id)"""
SQL["j6_pca_variance"] = f"""WITH RECURSIVE {FX_VEC_SQL}, {PCA_SQL}, tt AS (SELECT sum(s) AS total FROM pv WHERE i = j),
o AS (SELECT 1::BIGINT AS component, var_samp(pc1) AS variance FROM pp UNION ALL SELECT 2, var_samp(pc2) FROM pp)
SELECT component, round(variance, 6) AS variance, round(variance / total, 6) AS share, 1.0::DOUBLE AS length, 0.0::DOUBLE AS product FROM o, tt"""
SQL["j6_pca_project"] = f"""WITH RECURSIVE {dens_ctes()}, {D1ROWS}, {E1SEL}, {PCA_SQL}
SELECT e1.vec_id, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2 FROM pp JOIN e1 USING (vec_id)"""
SQL["j2_score_text"] = f"""WITH {FX_DOCS_SQL},
c AS (SELECT doc_id, greatest(length(coalesce(text, '')), 1) AS n,
             length(regexp_replace(coalesce(text, ''), '[^\\p{{Lu}}]', '', 'g')) AS caps,
             length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS bangs FROM fx_docs),
p AS (SELECT doc_id, 1.0 / (1.0 + exp(-(20.0 * caps / n + 5.0 * bangs / n - 1.0))) AS p FROM c)
SELECT doc_id, 'lexical' AS model, CASE WHEN p >= 0.5 THEN 'hate' ELSE 'no hate' END AS prediction,
  round(p, 6) AS score FROM p"""
SQL["j5_fixed_length_tokens"] = """SELECT doc_id, 140::BIGINT AS n_tokens,
  least(len(string_split(text, ' ')), 140)::BIGINT AS n_real, string_split(text, ' ')[1] AS first_token FROM documents"""


# named options
def option_sql(r: str, d: str) -> str:
    """D1 rows with the k-th distance ``r`` and the dimension ``d`` of the volume formula."""
    return f"""WITH {dens_ctes()}, o AS (SELECT qid, n_ref, k_used, {r} AS r, {d}::DOUBLE AS dd, kth_distance FROM dens
  JOIN (SELECT len(v) AS d FROM fx_vec LIMIT 1) ON true
  WHERE k = {C.K} AND target_term = {T0} AND source_term <> {T0}),
p AS (SELECT *, dd / 2.0 * ln(pi()) + dd * ln(greatest(r, 1e-10)) - lgamma(dd / 2.0 + 1) AS log_volume FROM o)
SELECT qid AS vec_id, n_ref, k_used, round(r, 6) AS kth_distance, round(log_volume, 6) AS log_volume,
  round(ln(k_used) - ln(n_ref) - log_volume, 6) AS log_density FROM p"""


SQL["a5_read_weights_csv_median"] = f"""WITH {dens_ctes()} SELECT source_term AS model,
  round(quantile_cont(log_density, 0.5), 6) AS weight
FROM dens WHERE k = {C.K} AND target_term = {T0} AND source_term <> {T0} GROUP BY source_term"""
SQL["d1_radius_euclidean"] = option_sql("sqrt(kth_distance)", "d")
SQL["d1_dim_mode_n_ref"] = option_sql("kth_distance", "n_ref")
SQL["d1_several_blocks"] = option_sql("kth_distance", "d")
SQL["c1_zero_policy_nan"] = f"""WITH {FX_VEC_SQL}, {NV_SQL},
z AS (SELECT vec_id, v FROM nv WHERE term = {T0} AND vec_id IN (SELECT vec_id FROM fx_vec WHERE v[1] >= 0)),
none AS (SELECT vec_id FROM fx_vec WHERE term = {T0} AND v[1] < 0),
p AS (SELECT a.vec_id AS qid, b.vec_id AS rid, power(list_distance(a.v, b.v), 2) AS d2 FROM nv a, z b WHERE a.term <> {T0}
      UNION ALL SELECT a.vec_id, none.vec_id, 'nan'::DOUBLE FROM nv a, none WHERE a.term <> {T0}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY isnan(d2), d2, rid) - 1 AS rank FROM p)
SELECT qid, rank::BIGINT AS rank, rid, round(d2, 6) AS distance FROM r WHERE rank < {C.K}"""
SQL["d7_histogram_series"] = f"""WITH {dens_ctes()},
s AS (SELECT source_term AS term, log_density FROM dens WHERE k = {C.K} AND target_term = {T0} AND source_term <> {T0}),
mm AS (SELECT min(log_density) AS lo, max(log_density) AS hi FROM s),
b AS (SELECT term, least(floor((log_density - lo) / (hi - lo) * 20.0) + 1, 20)::INTEGER AS bin FROM s, mm),
cnt AS (SELECT term, bin, count(*) AS c FROM b GROUP BY term, bin),
grid AS (SELECT DISTINCT term, range::INTEGER AS bin FROM s, range(1, 21))
SELECT grid.term, grid.bin, round(lo + (grid.bin - 1) * ((hi - lo) / 20), 6) AS bin_lo,
  round(lo + grid.bin * ((hi - lo) / 20), 6) AS bin_hi, coalesce(c, 0)::BIGINT AS count
FROM grid CROSS JOIN mm LEFT JOIN cnt ON cnt.term = grid.term AND cnt.bin = grid.bin"""
SQL["e9_best_model_single_class"] = f"""WITH {LEADERBOARD},
r AS (SELECT model, model = '{C.SUBJECT_MODEL}' AS no_auc, auc_roc FROM lb),
t AS (SELECT model FROM r WHERE NOT no_auc ORDER BY auc_roc DESC, model LIMIT 1)
SELECT r.model, no_auc, r.model = t.model AS best FROM r, t"""
# the same rows by the pruned joins
SQL["c1_knn_topk_pivots"] = SQL["c1_knn_topk"]
SQL["d2_knn_log_density_all_pivots"] = SQL["d2_knn_log_density_all"]
SQL["d9_similarity_cosine_pivots"] = SQL["d9_similarity_cosine"]

NAN_ROWS = f"""{FX_VEC_SQL}, nr AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 3 THEN 'nan'::DOUBLE WHEN vec_id % 11 = 5 THEN NULL
  ELSE list_sum(list_transform(v, lambda x: x)) END AS density FROM fx_vec)"""
NAN_TOP = """row_number() OVER ({part}ORDER BY CASE WHEN isnan(density) THEN NULL ELSE density END DESC NULLS LAST, vec_id)"""
SQL["e1_select_top_density_nan"] = f"""WITH {NAN_ROWS}
SELECT vec_id, round(CASE WHEN isnan(density) THEN NULL ELSE density END, 6) AS density FROM nr
QUALIFY {NAN_TOP.format(part='')} <= floor(0.9::DOUBLE * (SELECT count(*) FROM nr))"""
SQL["e2_select_top_balanced_nan"] = f"""WITH {NAN_ROWS}
SELECT vec_id, label, round(CASE WHEN isnan(density) THEN NULL ELSE density END, 6) AS density FROM nr
QUALIFY {NAN_TOP.format(part='PARTITION BY label ')} <= (SELECT round_even(floor(0.9::DOUBLE * count(*)) / 2, 0) FROM nr)"""
SQL["b10_density_weight_nan"] = f"""WITH {NAN_ROWS},
g AS (SELECT vec_id, CASE WHEN isnan(density) THEN NULL ELSE density END AS d FROM nr),
s AS (SELECT min(d) AS lo, max(d) AS hi, quantile_cont(d, 0.5) AS med FROM g)
SELECT vec_id, round(coalesce(d, med), 6) AS density, round(0.1 + (coalesce(d, med) - lo) / (hi - lo) * 1.9, 6) AS density_weight FROM g, s"""
SQL["d7_histogram_nan"] = f"""WITH {NAN_ROWS},
g AS (SELECT density AS d FROM nr WHERE isfinite(density)),
mm AS (SELECT min(d) AS lo, max(d) AS hi FROM g),
cnt AS (SELECT least(floor((d - lo) / (hi - lo) * 20.0::DOUBLE) + 1, 20)::INTEGER AS bin, count(*) AS c FROM g, mm GROUP BY 1)
SELECT b.bin::INTEGER AS bin, round(lo + (b.bin - 1) * ((hi - lo) / 20), 6) AS bin_lo, round(lo + b.bin * ((hi - lo) / 20), 6) AS bin_hi,
  coalesce(c, 0)::BIGINT AS count FROM range(1, 21) b(bin) CROSS JOIN mm LEFT JOIN cnt ON cnt.bin = b.bin
UNION ALL SELECT NULL, NULL, NULL, count(*) FROM nr WHERE NOT isfinite(density)"""

# wide and optional forms
SQL["h2_confusion_normalised_total"] = f"""WITH {SC}, {conf_sql('cf', 'sc', 'model')}, t AS (SELECT *, (tn + fp + fn + tp)::DOUBLE AS n FROM cf)
SELECT model, tn, fp, fn, tp, round(tn / n, 6) AS tn_norm, round(fp / n, 6) AS fp_norm, round(fn / n, 6) AS fn_norm, round(tp / n, 6) AS tp_norm
FROM t"""
SQL["d3_matrix_wide"] = f"""WITH {dens_ctes()}, {MATRIX} SELECT source_term, """ + ", ".join(
    f"round(max(CASE WHEN target_term = 't{i}' THEN avg_density END), 6) AS t{i}" for i in range(10)) + """
FROM matrix GROUP BY source_term"""
SQL["i7_summary_wide"] = SQL["i7_cross_term_summary"].rpartition("SELECT model, metric, round(")[0] + "SELECT model, " + ", ".join(
    f"round(max(CASE WHEN metric = '{m}' THEN {e} END), 6) AS {m}_{c}"
    for m in ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "auc_roc")
    for c, e in (("in_domain", "in_domain"), ("out_domain", "out_domain"), ("drop", "in_domain - out_domain"))) + " FROM g GROUP BY model"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
