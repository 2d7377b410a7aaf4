"""DuckDB SQL for each registered query (same names, same columns)."""

from __future__ import annotations

from itemscope.plans.context import GRID, ITERS
from itemscope.plans.oracle import (disagreement_sel_sql, naive_sql, quotas_sql,
                                    random_sel_sql, with_ctes)

SQL: dict[str, str] = {}


def sql(name: str, ctes, final: str) -> None:
    SQL[name] = with_ctes(ctes, final)


def _sel_out(inner: str) -> str:
    return f"""SELECT split_id, sampling, n_items, iter, scenario, item_id, item_pos,
       round(weight, 6) AS weight FROM ({inner})"""


# ------------------------------------------------------------ flagship
sql("flagship_pds_naive_mae", ("items", "pds", "test_scores", "truth"), f"""
SELECT e.split_id, e.sampling, e.n_items, e.scenario,
       round(avg(abs(e.acc_hat - t.acc)), 6) AS mae,
       round(max(abs(e.acc_hat - t.acc)), 6) AS max_err,
       count(*) AS n_models
FROM ({naive_sql(disagreement_sel_sql(GRID, 'pds', True, True))}) e
JOIN truth t ON e.split_id = t.split_id AND e.model_id = t.model_id AND e.scenario = t.scenario
GROUP BY e.split_id, e.sampling, e.n_items, e.scenario""")

# ------------------------------------------------------------ items / splits
sql("item_positions", ("items",), "SELECT item_id, scenario, sub, item_pos FROM items")
sql("balance_weights", ("items",),
    "SELECT item_id, scenario, sub, n_i, n_scenario, n_sub, round(bal_w, 6) AS bal_w FROM items")
sql("systematic_split", ("splits",),
    "SELECT model_id, model_pos, role FROM splits WHERE split_id = 'iid'")
sql("chronological_split", ("splits",),
    "SELECT model_id, model_pos, role FROM splits WHERE split_id = 'noniid'")

# ------------------------------------------------------------ statistics
sql("pds_scores", ("pds",), "SELECT split_id, item_id, round(score, 6) AS pds FROM pds")

sql("jsd_scores", ("train_p",), """
SELECT split_id, item_id, round(avg(kl), 6) AS jsd FROM (
  SELECT pn.split_id, pn.item_id, pn.model_id,
         sum(pn.q * (ln(pn.q) - ln(m.m / m.ms))) AS kl
  FROM (SELECT split_id, item_id, model_id, class_id,
               greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY split_id, item_id, model_id) AS q
        FROM train_p) pn
  JOIN (SELECT split_id, item_id, class_id, greatest(mr, 1e-12) AS m,
               sum(greatest(mr, 1e-12)) OVER (PARTITION BY split_id, item_id) AS ms
        FROM (SELECT split_id, item_id, class_id, avg(q) AS mr FROM (
                SELECT split_id, item_id, model_id, class_id,
                       greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY split_id, item_id, model_id) AS q
                FROM train_p) GROUP BY split_id, item_id, class_id)) m
    ON pn.split_id = m.split_id AND pn.item_id = m.item_id AND pn.class_id = m.class_id
  GROUP BY pn.split_id, pn.item_id, pn.model_id)
GROUP BY split_id, item_id""")

sql("true_accuracy", ("truth",),
    "SELECT split_id, model_id, scenario, round(acc, 6) AS acc FROM truth")

sql("quota", ("items",), f"""
SELECT scenario, sub, n_items, sub_rank::INT AS sub_rank, quota FROM ({quotas_sql((7, 10, 25, 40))})""")

# ------------------------------------------------------------ selection
sql("top_disagreement_stratified", ("items", "pds"),
    _sel_out(disagreement_sel_sql(GRID, "pds", True, True)))
sql("low_disagreement_stratified", ("items", "pds"),
    _sel_out(disagreement_sel_sql(GRID, "pds", False, True)))
sql("top_disagreement_global", ("items", "pds"),
    _sel_out(disagreement_sel_sql(GRID, "pds", True, False)))
sql("random_stratified", ("items",), _sel_out(random_sel_sql(GRID, ITERS)))

# ------------------------------------------------------------ estimators
sql("naive_estimate", ("items", "test_scores"), f"""
SELECT split_id, model_id, sampling, n_items, iter, scenario, round(acc_hat, 6) AS acc_hat
FROM ({naive_sql(random_sel_sql(GRID, ITERS))})""")


# ------------------------------------------------------------ F6 estimates + metrics
EST = "split_id, model_id, sampling, estimator, n_items, iter, scenario"
METHOD = "split_id, sampling, estimator, n_items"

sql("fixture_estimates", ("estimates",),
    f"SELECT {EST}, round(acc_hat, 6) AS acc_hat FROM estimates")
sql("knn_estimate", ("estimates",),
    f"SELECT {EST}, round(acc_hat, 6) AS acc_hat FROM estimates WHERE estimator = 'KNN'")
sql("perfect_knn", ("pknn",),
    "SELECT split_id, model_id, scenario, round(acc_hat, 6) AS acc_hat FROM pknn")
sql("mean_train_score", ("train_scores",),
    "SELECT split_id, round(avg(score), 6) AS mean_train_score FROM train_scores GROUP BY split_id")
sql("abs_error", ("estimates", "truth"), f"""
SELECT e.split_id, e.model_id, e.sampling, e.estimator, e.n_items, e.iter, e.scenario,
       round(e.acc_hat, 6) AS acc_hat, round(abs(e.acc_hat - t.acc), 6) AS abs_err
FROM estimates e JOIN truth t ON e.split_id = t.split_id AND e.model_id = t.model_id
 AND e.scenario = t.scenario""")

LB_PER = f"""
SELECT l.*, m.truth, abs(l.est - m.truth) AS err FROM
  (SELECT {METHOD}, model_id, iter, avg(acc_hat) AS est FROM estimates
   GROUP BY {METHOD}, model_id, iter) l
JOIN (SELECT split_id, model_id, avg(acc) AS truth FROM truth GROUP BY split_id, model_id) m
  ON l.split_id = m.split_id AND l.model_id = m.model_id"""

SC_PER = f"""
SELECT {METHOD}, e.model_id, iter, avg(abs(e.acc_hat - t.acc)) AS err
FROM estimates e JOIN truth t USING (split_id, model_id, scenario)
GROUP BY {METHOD}, e.model_id, iter"""


def _mae(per: str, seed_stat: str = "avg") -> str:
    return f"""
SELECT {METHOD}, round(avg(e), 6) AS mae, round(stddev_pop(e), 6) AS spread FROM (
  SELECT {METHOD}, model_id, {seed_stat}(err) AS e FROM ({per}) GROUP BY {METHOD}, model_id)
GROUP BY {METHOD}"""


sql("mae_leaderboard", ("estimates", "truth"), _mae(LB_PER))
sql("mae_scenarios", ("estimates", "truth"), _mae(SC_PER))
sql("mae_seed_std", ("estimates", "truth"), _mae(LB_PER, "stddev_pop"))
sql("spread_seeds", ("estimates", "truth"), f"""
SELECT a.split_id, a.sampling, a.estimator, a.n_items, a.mae, b.spread FROM
 (SELECT {METHOD}, round(avg(e), 6) AS mae FROM (
    SELECT {METHOD}, model_id, avg(err) AS e FROM ({LB_PER}) GROUP BY {METHOD}, model_id)
  GROUP BY {METHOD}) a
JOIN (SELECT {METHOD}, round(stddev_pop(m), 6) AS spread FROM (
        SELECT {METHOD}, iter, avg(err) AS m FROM ({LB_PER}) GROUP BY {METHOD}, iter)
      GROUP BY {METHOD}) b USING ({METHOD})""")


def _spearman(per: str, keys: str, x: str = "est", y: str = "truth") -> str:
    """Per-seed Spearman rows (keys include iter); NaN when a side is constant."""
    return f"""
SELECT {keys}, CASE WHEN sx < 1e-9 OR sy < 1e-9 THEN 'NaN'::DOUBLE ELSE rho END AS rho FROM (
  SELECT {keys}, corr(rx, ry) AS rho, stddev_pop({x}) AS sx, stddev_pop({y}) AS sy FROM (
    SELECT *,
      rank() OVER (PARTITION BY {keys} ORDER BY {x})
        + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY {keys} ORDER BY {y})
        + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0 AS ry
    FROM ({per})) GROUP BY {keys})"""


def _nan_null(x: str) -> str:
    return f"round(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, 6)"


sql("spearman", ("estimates", "truth"), f"""
SELECT {METHOD}, {_nan_null('avg(rho)')} AS rank_corr
FROM ({_spearman(LB_PER, METHOD + ', iter')}) GROUP BY {METHOD}""")

SC_PAIRS = f"""
SELECT {METHOD}, e.scenario, iter, e.model_id, e.acc_hat AS est, t.acc AS truth
FROM estimates e JOIN truth t USING (split_id, model_id, scenario)"""

sql("spearman_scenarios", ("estimates", "truth"), f"""
SELECT {METHOD}, scenario, {_nan_null('avg(rho)')} AS rank_corr
FROM ({_spearman(SC_PAIRS, METHOD + ', scenario, iter')}) GROUP BY {METHOD}, scenario""")

sql("metric_levels", ("estimates", "truth"), f"""
SELECT m.split_id, m.sampling, m.estimator, m.n_items, m.scenario, m.mae, m.spread, m.mae_scenarios, r.rank_corr FROM (
  SELECT a.*, b.mae AS mae_scenarios FROM (SELECT *, '(all)' AS scenario FROM ({_mae(LB_PER)})) a
  JOIN ({_mae(SC_PER)}) b USING ({METHOD})
  UNION ALL BY NAME
  SELECT {METHOD}, scenario, round(avg(e), 6) AS mae, round(stddev_pop(e), 6) AS spread, NULL::DOUBLE AS mae_scenarios
  FROM (SELECT {METHOD}, scenario, model_id, avg(abs(est - truth)) AS e FROM ({SC_PAIRS}) GROUP BY {METHOD}, scenario, model_id)
  GROUP BY {METHOD}, scenario) m
JOIN (SELECT {METHOD}, '(all)' AS scenario, {_nan_null('avg(rho)')} AS rank_corr
      FROM ({_spearman(LB_PER, METHOD + ', iter')}) GROUP BY {METHOD}
      UNION ALL
      SELECT {METHOD}, scenario, {_nan_null('avg(rho)')} AS rank_corr
      FROM ({_spearman(SC_PAIRS, METHOD + ', scenario, iter')}) GROUP BY {METHOD}, scenario) r
  USING ({METHOD}, scenario)""")

WR_PER = f"""
SELECT e.*, t.truth FROM
 (SELECT {METHOD}, iter, model_id, avg(wr) AS est FROM (
    SELECT {METHOD}, iter, scenario, model_id,
           (row_number() OVER (PARTITION BY {METHOD}, iter, scenario ORDER BY acc_hat, model_id) - 1)
             / count(*) OVER (PARTITION BY {METHOD}, iter, scenario) AS wr
    FROM estimates) GROUP BY {METHOD}, iter, model_id) e
JOIN (SELECT split_id, model_id, avg(wr) AS truth FROM (
        SELECT split_id, scenario, model_id,
               (row_number() OVER (PARTITION BY split_id, scenario ORDER BY acc, model_id) - 1)
                 / count(*) OVER (PARTITION BY split_id, scenario) AS wr
        FROM truth) GROUP BY split_id, model_id) t
  ON e.split_id = t.split_id AND e.model_id = t.model_id"""

sql("win_rate", ("estimates", "truth"), f"""
SELECT a.split_id, a.sampling, a.estimator, a.n_items, a.mae, b.rank_corr FROM
 (SELECT {METHOD}, round(avg(e), 6) AS mae FROM (
    SELECT {METHOD}, model_id, avg(abs(est - truth)) AS e FROM ({WR_PER}) GROUP BY {METHOD}, model_id)
  GROUP BY {METHOD}) a
JOIN (SELECT {METHOD}, {_nan_null('avg(rho)')} AS rank_corr
      FROM ({_spearman(WR_PER, METHOD + ', iter')}) GROUP BY {METHOD}) b USING ({METHOD})""")

sql("per_model_table", ("estimates", "truth"), f"""
SELECT {METHOD}, model_id, round(avg(est), 6) AS estimate, round(any_value(truth), 6) AS truth
FROM ({LB_PER}) GROUP BY {METHOD}, model_id""")


# ------------------------------------------------------------ thresholds, variance, IRT pieces
sql("threshold_search", ("thresholds",),
    "SELECT split_id, scenario, k, round(threshold, 6) AS threshold FROM thresholds")
sql("binarize", ("thresholds", "test_soft"), """
SELECT t.split_id, t.model_id, t.item_id, (t.score > h.threshold)::INT AS resp
FROM test_soft t JOIN thresholds h ON t.split_id = h.split_id AND t.scenario = h.scenario""")
sql("score_variance", ("train_soft",), """
SELECT split_id, scenario, round(avg(v), 6) AS score_var FROM (
  SELECT split_id, scenario, model_id, var_pop(score) AS v FROM train_soft
  GROUP BY split_id, scenario, model_id) GROUP BY split_id, scenario""")
sql("irt_validation_error", ("i6",), "SELECT scenario, round(b, 6) AS b FROM i6")
sql("shrinkage_lambda", ("i6", "f5p", "items"), f"""
SELECT v.scenario, g.n_items, k.kind,
       round(e.b * e.b / (CASE WHEN k.kind = 'random' THEN v.score_var / g.n_items
                               ELSE v.score_var / (4 * g.n_items) END + e.b * e.b), 6) AS lambda
FROM (SELECT scenario, avg(vv) AS score_var FROM (
        SELECT i.scenario, f.model_id, var_pop(f.resp::DOUBLE) AS vv
        FROM f5p f JOIN items i USING (item_id) WHERE f.model_id % 5 <> 0
        GROUP BY i.scenario, f.model_id) GROUP BY scenario) v
JOIN i6 e USING (scenario),
(SELECT unnest([10, 20, 40]) AS n_items) g, (SELECT unnest(['random', 'other']) AS kind) k""")
sql("guided_pds", ("pds", "pds10"), """
SELECT split_id, 'all' AS variant, item_id, round(score, 6) AS pds FROM pds
UNION ALL SELECT split_id, '@10', item_id, round(score, 6) FROM pds10""")
HIGH_SEL = disagreement_sel_sql(GRID, "pds", True, True)
sql("unseen_items", ("items", "pds"), f"""
SELECT c.split_id, c.sampling, c.n_items, c.iter, c.scenario, i.item_id
FROM (SELECT DISTINCT split_id, sampling, n_items, iter, scenario FROM ({HIGH_SEL})) c
JOIN items i ON i.scenario = c.scenario
WHERE NOT EXISTS (SELECT 1 FROM ({HIGH_SEL}) s WHERE s.split_id = c.split_id AND s.sampling = c.sampling
                  AND s.n_items = c.n_items AND s.iter = c.iter AND s.item_id = i.item_id)""")
sql("nearest_anchor_weights", ("items", "pds", "f5"), f"""SELECT * FROM (
WITH params AS (SELECT DISTINCT item_id, a, b FROM f5),
sel AS ({HIGH_SEL}),
it AS (SELECT i.item_id, i.scenario, i.bal_w / sum(i.bal_w) OVER (PARTITION BY i.scenario) AS nbw, p.a, p.b
       FROM items i JOIN params p USING (item_id)),
near AS (
  SELECT split_id, sampling, n_items, iter, scenario, item_id, nbw, anchor_id FROM (
    SELECT s.split_id, s.sampling, s.n_items, s.iter, s.scenario, it.item_id, it.nbw, s.item_id AS anchor_id,
           row_number() OVER (PARTITION BY s.split_id, s.sampling, s.n_items, s.iter, s.scenario, it.item_id
                              ORDER BY round(sqrt((it.a - ap.a) * (it.a - ap.a) + (it.b - ap.b) * (it.b - ap.b)), 12),
                                       s.item_pos) AS rn
    FROM sel s JOIN params ap ON ap.item_id = s.item_id JOIN it ON it.scenario = s.scenario) WHERE rn = 1)
SELECT s.split_id, s.sampling, s.n_items, s.iter, s.scenario, s.item_id,
       round(coalesce(w.weight, 0.0), 6) AS weight
FROM sel s LEFT JOIN (SELECT split_id, sampling, n_items, iter, scenario, anchor_id, sum(nbw) AS weight
                      FROM near GROUP BY ALL) w
  ON s.split_id = w.split_id AND s.sampling = w.sampling AND s.n_items = w.n_items AND s.iter = w.iter
 AND s.scenario = w.scenario AND s.item_id = w.anchor_id)""")
sql("item_curve", ("f5p",), "SELECT model_id, item_id, round(p, 6) AS p, resp FROM f5p")
sql("item_likelihood", ("f5p",), """
SELECT model_id, round(sum(ln(CASE WHEN resp = 1 THEN p ELSE 1.0 - p END)), 6) AS loglik
FROM f5p GROUP BY model_id""")
sql("fisher_information", ("f5p",), """
SELECT model_id, 0 AS i, 0 AS j, round(sum(p * (1.0 - p) * a * a), 6) AS info FROM f5p GROUP BY model_id""")


# ------------------------------------------------------------ result tables
from itemscope.plans.oracle import best_sql, fit_sql, report_sql  # noqa: E402

PIVOT = """
SELECT split_id, n_items, sampling,
       round(max(CASE WHEN estimator = 'naive' THEN mae END), 6) AS naive,
       round(max(CASE WHEN estimator = 'KNN' THEN mae END), 6) AS KNN,
       round(max(CASE WHEN estimator = 'mean_train_score' THEN mae END), 6) AS mean_train_score,
       round(max(CASE WHEN estimator = 'perfect_knn' THEN mae END), 6) AS perfect_knn
FROM lb_mae GROUP BY split_id, n_items, sampling"""
LONG_OUT = "split_id, n_items, row_label, estimator, round(value, 6) AS value"

sql("perf_pivot", ("lb_mae",), PIVOT)
sql("sampling_metadata", ("meta",), "SELECT * FROM meta")
sql("text_cells", ("lb_mae",), """
SELECT split_id, n_items, sampling,
       max(CASE WHEN estimator = 'naive' THEN printf('%.6f+-%.6f', mae, spread) END) AS naive,
       max(CASE WHEN estimator = 'KNN' THEN printf('%.6f+-%.6f', mae, spread) END) AS KNN,
       max(CASE WHEN estimator = 'mean_train_score' THEN printf('%.6f+-%.6f', mae, spread) END)
         AS mean_train_score,
       max(CASE WHEN estimator = 'perfect_knn' THEN printf('%.6f+-%.6f', mae, spread) END) AS perfect_knn
FROM lb_mae GROUP BY split_id, n_items, sampling""")
sql("display_table", ("lb_mae", "meta", "splits"), f"""
SELECT p.split_id, p.n_items,
       row_number() OVER (PARTITION BY p.split_id, p.n_items
                          ORDER BY m.pds_type ASC NULLS LAST, m.stratified ASC NULLS LAST,
                                   (CASE WHEN m.guiding_models = 'all' THEN n.n_train
                                         ELSE m.guiding_models::INT END)::INT ASC NULLS LAST,
                                   p.sampling)::INT AS row_order,
       p.sampling,
       (CASE WHEN m.guiding_models = 'all' THEN n.n_train ELSE m.guiding_models::INT END)::INT
         AS guiding_count,
       m.pds_type, m.stratified, p.naive, p.KNN, p.mean_train_score, p.perfect_knn
FROM ({PIVOT}) p JOIN meta m USING (sampling)
JOIN (SELECT split_id, count(*) AS n_train FROM splits WHERE role = 'train' GROUP BY split_id) n
  USING (split_id)""")
sql("merge_results", ("lb_mae", "lb_mae_b"), """
SELECT split_id, sampling, estimator, n_items, round(mae, 6) AS mae, round(spread, 6) AS spread FROM (
  SELECT * FROM lb_mae WHERE estimator IN ('naive', 'KNN')
  UNION ALL
  SELECT b.* FROM lb_mae_b b WHERE NOT EXISTS (
    SELECT 1 FROM lb_mae a WHERE a.estimator IN ('naive', 'KNN') AND a.split_id = b.split_id
      AND a.sampling = b.sampling AND a.estimator = b.estimator AND a.n_items = b.n_items))""")
sql("best_per_group", ("long_a", "meta"), f"SELECT {LONG_OUT} FROM ({best_sql('long_a')})")
sql("select_on_source_report_target", ("long_a", "long_b", "meta"),
    f"SELECT {LONG_OUT} FROM ({report_sql('long_a', 'long_b')})")
DROPPED = "estimator NOT IN ('MLP3_e700_lr0.001', 'Ridge_10', 'Lasso_e-4', 'GradientBoostingRegressor_200')"


def _fit(a, b, lower, keep):
    src = f"SELECT * FROM ({best_sql(a, 'pds_type', lower)}) WHERE {DROPPED}"
    tgt = f"SELECT * FROM ({report_sql(a, b, 'pds_type', lower)}) WHERE {DROPPED}"
    return fit_sql(src, tgt, ("naive", "KNN"), lower, keep)


sql("rowwise_best", ("long_a", "long_b", "meta"), f"SELECT {LONG_OUT} FROM ({_fit('long_a', 'long_b', True, False)})")

ROWS = """(VALUES (1, 'Baseline', 'Random', 'Eval', 'random', 'naive'),
 (2, 'IRT baseline', 'Random', 'gp-IRT', 'random', 'gpirt'),
 (3, 'IRT baseline', 'anchor-IRT', 'gp-IRT', 'anchor-irt', 'gpirt'),
 (4, 'IRT baseline', 'anchor-correctness', 'gp-IRT', 'anchor', 'gpirt'),
 (5, 'Baseline', 'Random', 'kNN', 'random', 'KNN'),
 (6, 'Baseline', 'Random', 'fit', 'random', 'fit'),
 (7, 'Disagreement', 'High PDS', 'kNN', 'highest', 'KNN'),
 (8, 'Disagreement', 'High PDS', 'fit', 'highest', 'fit'))
 AS spec(row_no, approach, condensation, prediction, row_label, estimator)"""
sql("main_table", ("long_a", "long_b", "rlong_a", "rlong_b", "meta"), f"""
SELECT spec.row_no::INT AS row_no, spec.approach, spec.condensation, spec.prediction,
       max(CASE WHEN m.split_id = 'iid' THEN round(m.value * 100, 2) END) AS iid_mae,
       max(CASE WHEN r.split_id = 'iid' THEN round(r.value, 3) END) AS iid_rank,
       max(CASE WHEN m.split_id = 'noniid' THEN round(m.value * 100, 2) END) AS noniid_mae,
       max(CASE WHEN r.split_id = 'noniid' THEN round(r.value, 3) END) AS noniid_rank,
       40 AS n_items
FROM {ROWS}
LEFT JOIN (SELECT * FROM ({_fit('long_a', 'long_b', True, True)}) WHERE n_items = 40) m
  ON m.row_label = spec.row_label AND m.estimator = spec.estimator
LEFT JOIN (SELECT * FROM ({_fit('rlong_a', 'rlong_b', False, True)}) WHERE n_items = 40) r
  ON r.row_label = spec.row_label AND r.estimator = spec.estimator
 AND (m.split_id IS NULL OR r.split_id = m.split_id)
GROUP BY spec.row_no, spec.approach, spec.condensation, spec.prediction""")
sql("result_fanout", ("lb_mae", "lb_rank"), """
SELECT split_id, sampling, estimator, n_items, round(m.mae, 6) AS mae, round(m.spread, 6) AS spread,
       round(r.rank_corr, 6) AS rank_corr
FROM lb_mae m JOIN lb_rank r USING (split_id, sampling, estimator, n_items)""")
sql("stratification_ablation", ("long_a", "meta"), f"SELECT {LONG_OUT} FROM ({best_sql('long_a', 'stratified')})")
sql("display_names", ("lb_mae",), """
SELECT split_id, n_items, method, coalesce(lut.label, method) AS label, round(mae, 6) AS mae FROM (
  SELECT *, CASE WHEN estimator IN ('mean_train_score', 'perfect_knn') THEN estimator
                 ELSE concat_ws('_', sampling, estimator) END AS method FROM lb_mae) x
LEFT JOIN (VALUES ('anchor', 'correct.'), ('anchor-irt', 'IRT'), ('anchor-irt_gpirt', 'IRT++'),
                  ('anchor-irt_naive', 'IRT'), ('anchor-irt_pirt', 'IRT+'), ('anchor_gpirt', 'correct.++'),
                  ('anchor_naive', 'correct.'), ('anchor_pirt', 'correct.+'),
                  ('mean_train_score', 'mean train score'), ('random_gpirt', 'random++'),
                  ('random_naive', 'random'), ('random_pirt', 'random+')) AS lut(m, label)
  ON lut.m = x.method""")
sql("largest_n_table", ("lb_mae",), f"SELECT * FROM ({PIVOT}) WHERE n_items = 40")


def _diff_sql(a: str, b: str, keys: list, cols: list) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    ktxt = "concat_ws('|', " + ", ".join(f"coalesce(a.{k}, b.{k})::VARCHAR" for k in keys) + ")"
    parts = []
    for c in cols:
        diff = f"(a.__in AND b.__in AND a.{c} IS DISTINCT FROM b.{c})"
        parts.append(f"""
SELECT '{c}' AS "column", sum(CASE WHEN b.__in IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_a,
       sum(CASE WHEN a.__in IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_b,
       sum(CASE WHEN {diff} THEN 1 ELSE 0 END)::BIGINT AS n_diff,
       coalesce(list_sort(list_slice(list_sort(list({ktxt}) FILTER (WHERE {diff})), 1, 3)), []::VARCHAR[])
         AS examples
FROM (SELECT *, true AS __in FROM ({a})) a FULL JOIN (SELECT *, true AS __in FROM ({b})) b ON {on}""")
    return "\nUNION ALL\n".join(parts)


EST_A = f"SELECT {EST}, round(acc_hat, 6) AS acc_hat FROM estimates"
EST_B = f"SELECT {EST}, round(acc_hat, 6) AS acc_hat FROM estimates_b"
sql("table_diff", ("estimates", "estimates_b"),
    _diff_sql(EST_A, EST_B, EST.split(", "), ["acc_hat"]))
sql("consistency_check", ("long_a", "meta"),
    _diff_sql(f"SELECT {LONG_OUT} FROM ({report_sql('long_a', 'long_a')})",
              f"SELECT {LONG_OUT} FROM ({best_sql('long_a')})",
              ["split_id", "n_items", "row_label", "estimator"], ["value"]))


# ------------------------------------------------------------ ETL over nested raw logs
sql("parse_and_pad", ("f4a",), """
SELECT model_id, sub, item_no, round(score, 6) AS score, n_answers, (4 - n_answers)::INT AS pad_count,
       round(logit_sum, 6) AS logit_sum FROM f4a""")
sql("snapshot_merge", ("f4_cells",),
    "SELECT model_id, sub, snapshot, n_items, round(score_sum, 6) AS score_sum FROM f4_cells")
sql("completeness_filter", ("f4_cells",), """
SELECT model_id FROM f4_cells GROUP BY model_id
HAVING count(*) FILTER (WHERE score_sum IS NOT NULL) = (SELECT count(DISTINCT label) FROM embeddings)""")
sql("model_run_dates", ("models",), "SELECT model_id, run_date, model_pos FROM models")
sql("drop_models", ("models",), "SELECT model_id FROM models WHERE model_id NOT IN (1, 2, 3)")
sql("dedupe_models", ("f4_cells",), """
SELECT model_id, (count(*) + CASE WHEN model_id BETWEEN 30 AND 39 THEN count(*) ELSE 0 END)::BIGINT AS n_rows
FROM f4_cells GROUP BY model_id""")
sql("answer_width", ("f4a",), "SELECT sub, max(n_answers)::INT AS max_answers FROM f4a GROUP BY sub")
sql("width_violations", ("f4a",),
    "SELECT model_id, sub, item_no, n_answers AS width FROM f4a WHERE n_answers > 3")
sql("optional_columns", ("f4_cells",), """
SELECT model_id, sub, NULL::VARCHAR AS example, 1 AS n_dates FROM f4_cells WHERE model_id <= 39""")
sql("catalog_sample", ("f2",), """
SELECT model_id, bench FROM (
  SELECT model_id, bench, row_number() OVER (ORDER BY model_id) AS rn FROM (
    SELECT s.s_suppkey::BIGINT AS model_id, coalesce(b.bench, 0.0) AS bench
    FROM supplier s LEFT JOIN (SELECT model_id, round(avg(score) * 100, 6) AS bench FROM f2 GROUP BY model_id) b
      ON b.model_id = s.s_suppkey) WHERE bench > 30)
WHERE (rn - 1) % 5 = 0""")
sql("metric_choice", ("f2",), """
SELECT sub, CASE WHEN contains(sub, 'arc') THEN 'acc_norm' WHEN contains(sub, 'hellaswag') THEN 'acc_norm'
                 WHEN contains(sub, 'truthfulqa') THEN 'mc2' ELSE 'acc' END AS metric
FROM (SELECT DISTINCT sub FROM f2)""")
sql("correctness_extraction", ("f2_metric",), """
SELECT model_id, sub, metric,
       CASE WHEN model_id % 9 = 2 THEN 0
            WHEN metric = 'mc2' AND model_id % 4 = 1 THEN 0 ELSE n END::INT AS n_items,
       round(CASE WHEN model_id % 9 = 2 THEN NULL WHEN metric = 'acc' THEN s_acc
                  WHEN metric = 'acc_norm' THEN s_norm ELSE NULL END, 6) AS score_sum
FROM f2_metric""")
sql("skipped_models", ("f2",), """
SELECT count(DISTINCT model_id) FILTER (WHERE model_id % 9 = 2)::BIGINT AS n_skipped,
       count(DISTINCT model_id) AS n_models FROM f2""")


# ------------------------------------------------------------ IRT chain
sql("irt_jsonl", ("f5p", "items"), """
SELECT model_id::VARCHAR AS subject_id,
       '{"subject_id":"' || model_id::VARCHAR || '","responses":{'
         || string_agg('"q' || i.item_pos::VARCHAR || '":' || f.resp::VARCHAR, ',' ORDER BY i.item_pos)
         || '}}' AS line
FROM f5p f JOIN items i USING (item_id) GROUP BY model_id""")


# ------------------------------------------------------------ streaming twins (batch semantics)
sql("stream_pds", ("f3",), """
SELECT item_id, round(max(score) + max(1.0 - score), 6) AS pds, count(*) AS n_rows
FROM f3 GROUP BY item_id""")
sql("stream_window_accuracy", ("f3",), """
SELECT model_id, epoch(date_trunc('day', ts))::BIGINT AS window_start, count(*) AS n,
       round(avg(score), 6) AS accuracy
FROM f3 GROUP BY model_id, date_trunc('day', ts)""")


# ------------------------------------------------------------ sparse scale log
sql("sparse_balance_weights", ("sp_items",),
    "SELECT item_id, scenario, sub, item_pos, round(bal_w, 6) AS bal_w FROM sp_items")
sql("sparse_true_accuracy", ("sp_items", "f2"), """
SELECT f.model_id, i.scenario, round(avg(i.bal_w * f.score), 6) AS acc
FROM f2 f JOIN sp_items i USING (item_id) GROUP BY f.model_id, i.scenario""")
sql("sparse_model_order", ("f2",), """
SELECT model_id, epoch(run_date)::BIGINT AS run_epoch,
       (row_number() OVER (ORDER BY run_date DESC, model_id) - 1)::INT AS model_pos
FROM (SELECT model_id, min(run_ts) AS run_date FROM f2 GROUP BY model_id)""")


# ------------------------------------------------------------ adaptive start (D = 1, planted)
sql("adaptive_start", ("f5p", "items"), """
SELECT i.item_id, m.item_pos, m.draw FROM (
  SELECT subset, item_pos, draw FROM (
    SELECT subset, item_pos, min(draw) AS draw FROM (
      SELECT s.range AS subset, d.range::INT AS draw,
             (('0x' || substr(md5(concat_ws(':', 42, s.range, d.range)), 1, 12))::BIGINT
               % (SELECT count(*) FROM items))::BIGINT AS item_pos
      FROM range(200) s, range(12) d)
    GROUP BY subset, item_pos)
  QUALIFY row_number() OVER (PARTITION BY subset ORDER BY draw) <= 6) m
JOIN items i ON i.item_pos = m.item_pos
WHERE m.subset = (
  SELECT subset FROM (
    SELECT mm.subset, sum(inf.info) AS value, count(*) AS n FROM (
      SELECT subset, item_pos FROM (
        SELECT subset, item_pos, min(draw) AS draw FROM (
          SELECT s.range AS subset, d.range::INT AS draw,
                 (('0x' || substr(md5(concat_ws(':', 42, s.range, d.range)), 1, 12))::BIGINT
                   % (SELECT count(*) FROM items))::BIGINT AS item_pos
          FROM range(200) s, range(12) d)
        GROUP BY subset, item_pos)
      QUALIFY row_number() OVER (PARTITION BY subset ORDER BY draw) <= 6) mm
    JOIN (SELECT i.item_pos, sum(f.p * (1.0 - f.p) * f.a * f.a) AS info
          FROM f5p f JOIN items i USING (item_id) WHERE f.model_id % 5 <> 0 GROUP BY i.item_pos) inf
      ON inf.item_pos = mm.item_pos
    GROUP BY mm.subset) WHERE n = 6
  ORDER BY value DESC, subset ASC LIMIT 1)""")


# ------------------------------------------------------------ splits, persistence, catalogue
sql("validation_split", ("splits",), """
SELECT split_id, model_id, CASE WHEN role = 'test' THEN NULL ELSE role END AS role FROM (
  SELECT split_id, model_id,
         CASE WHEN rn <= (SELECT count(*) FROM splits t WHERE t.split_id = r.split_id AND t.role = 'test')
              THEN 'val' ELSE 'train' END AS role
  FROM (SELECT split_id, model_id,
               row_number() OVER (PARTITION BY split_id ORDER BY
                 CASE WHEN split_id = 'iid' THEN md5(concat_ws(':', 0, model_id))
                      ELSE lpad(model_pos::VARCHAR, 12, '0') END, model_id) AS rn
        FROM splits WHERE role = 'train') r)""")
sql("limit_train", ("splits",), """
SELECT split_id, model_id, role FROM (
  SELECT *, row_number() OVER (PARTITION BY split_id, role ORDER BY model_pos) AS rn FROM splits)
WHERE role <> 'train' OR rn <= 20""")
sql("first_models", ("models",), "SELECT model_id, model_pos FROM models WHERE model_pos < 30")
sql("irt_params_roundtrip", ("f5", "items"), """
SELECT DISTINCT i.item_pos, round(f.a, 6) AS a, round(f.b, 6) AS b
FROM f5 f JOIN items i USING (item_id)""")
sql("saved_anchors_apply", ("items", "pds", "f1_scores"), f"""
SELECT f.model_id, s.scenario, round(sum(s.weight * f.score), 6) AS acc_hat
FROM f1_scores f JOIN (SELECT * FROM ({disagreement_sel_sql((10,), 'pds', True, True)})
                       WHERE split_id = 'iid') s ON s.item_id = f.item_id
GROUP BY f.model_id, s.scenario""")
sql("run_catalog_results", ("estimates",), """
SELECT 'f1' AS bench, split_id, family, estimator, count(*) AS n, round(avg(acc_hat), 6) AS mean_acc_hat
FROM (SELECT *, CASE WHEN estimator IN ('naive', 'KNN') THEN 'ours' ELSE 'constants' END AS family
      FROM estimates) GROUP BY split_id, family, estimator""")
sql("stage_cache", ("pds",), "SELECT split_id, item_id, round(score, 6) AS pds FROM pds")


sql("stacked_scores", ("f1_scores", "items"), """
SELECT f.model_id, i.item_pos, i.scenario, i.sub, round(f.score, 6) AS score
FROM f1_scores f JOIN items i USING (item_id)""")
sql("scenario_lookup", ("items", "pds"), f"""
SELECT s.split_id, s.n_items, s.item_id, i.scenario
FROM ({disagreement_sel_sql(GRID, 'pds', True, False)}) s LEFT JOIN items i USING (item_id)""")


def _pirt_sql(p_expr: str, name: str) -> str:
    sel = random_sel_sql(GRID, 1, split_ids=("planted",))
    return f"""
SELECT s.model_id, '{name}' AS estimator, s.sampling, s.n_items, s.iter, s.scenario,
       round((s.n_seen::DOUBLE / n.N) * s.data_part
             + (1.0 - s.n_seen::DOUBLE / n.N)
               * CASE WHEN n.N > s.n_seen THEN (t.p_all - s.p_seen) / (n.N - s.n_seen) ELSE 0.0 END, 6)
         AS acc_hat
FROM (SELECT f.model_id, c.sampling, c.n_items, c.iter, c.scenario, count(*) AS n_seen,
             avg(i.bal_w * f.resp::DOUBLE) AS data_part, sum(i.bal_w * {p_expr}) AS p_seen
      FROM ({sel}) c JOIN f5p f ON f.item_id = c.item_id JOIN items i ON i.item_id = c.item_id
      WHERE f.model_id % 5 = 0
      GROUP BY f.model_id, c.sampling, c.n_items, c.iter, c.scenario) s
JOIN (SELECT f.model_id, i.scenario, sum(i.bal_w * {p_expr}) AS p_all
      FROM f5p f JOIN items i USING (item_id) WHERE f.model_id % 5 = 0
      GROUP BY f.model_id, i.scenario) t ON t.model_id = s.model_id AND t.scenario = s.scenario
JOIN (SELECT scenario, count(*) AS N FROM items GROUP BY scenario) n ON n.scenario = s.scenario"""


sql("pirt_planted", ("f5p", "items"),
    _pirt_sql("f.p", "pirt") + "\nUNION ALL\n" + _pirt_sql("CASE WHEN f.p >= 0.5 THEN 1.0 ELSE 0.0 END", "cirt"))
