"""DuckDB twins of the registered queries (independent SQL oracle).

The fixture tables are written once as CTEs over the raw parquet views
(``embeddings``, ``lineitem``, ``part``, ``events``) and composed per query.
Rules that make hashes match: floats cast to DOUBLE before arithmetic,
round(x, 6) on every non-integer output, explicit tie-breaks, md5 for
pseudo-random order, no NaN in compared outputs.
"""

from __future__ import annotations

# name -> (dependencies, body).  Bodies are DuckDB SQL.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(names, final: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + final


# ----------------------------------------------------------------- F1
cte("f1", (), """
SELECT m.model_id, e.vec_id AS item_id,
       CASE WHEN e.label < 5 THEN 'alpha' ELSE 'beta' END AS scenario,
       e.label AS sub, c.class_id,
       8.0::DOUBLE * ((1.0::DOUBLE - m.model_id / 60.0::DOUBLE) * e.embedding[c.class_id + 1]::DOUBLE
             + (m.model_id / 60.0::DOUBLE) * e.embedding[5 + ((m.model_id * 4 + c.class_id) % 60)]::DOUBLE) AS logit
FROM embeddings e,
     (SELECT range::INT AS model_id FROM range(60)) m,
     (SELECT range::INT AS class_id FROM range(4)) c""")

cte("f1_mx", ("f1",), """
SELECT f1.*, max(logit) OVER (PARTITION BY model_id, item_id) AS mx FROM f1""")

cte("f1p", ("f1_mx",), """
SELECT model_id, item_id, scenario, sub, class_id,
       exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY model_id, item_id) AS p
FROM f1_mx""")

cte("f1_gold", (), """
SELECT vec_id AS item_id,
       list_position(list_slice(embedding, 1, 4), list_max(list_slice(embedding, 1, 4))) - 1 AS gold
FROM embeddings""")

cte("f1_pred", ("f1_mx",), """
SELECT model_id, item_id, any_value(scenario) AS scenario, any_value(sub) AS sub,
       min(class_id) FILTER (WHERE logit = mx) AS pred
FROM f1_mx GROUP BY model_id, item_id""")

cte("f1_scores", ("f1_pred", "f1_gold"), """
SELECT p.model_id, p.item_id, p.scenario, p.sub,
       CASE WHEN p.pred = g.gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM f1_pred p JOIN f1_gold g USING (item_id)""")

cte("f1_soft", ("f1p", "f1_gold"), """
SELECT p.model_id, p.item_id, p.scenario, p.sub, p.p AS score
FROM f1p p JOIN f1_gold g ON p.item_id = g.item_id AND p.class_id = g.gold""")

cte("models", (), """
SELECT model_id, run_date,
       (row_number() OVER (ORDER BY run_date DESC, model_id) - 1)::INT AS model_pos
FROM (SELECT range::INT AS model_id,
             (DATE '2024-01-01' + ((range::INT * 37) % 60)::INT) AS run_date FROM range(60))""")

cte("splits", ("models",), """
SELECT 'iid' AS split_id, model_id, model_pos,
       CASE WHEN model_pos % 5 = 0 THEN 'test' ELSE 'train' END AS role FROM models
UNION ALL
SELECT 'noniid', model_id, model_pos,
       CASE WHEN model_pos < 12 THEN 'test' ELSE 'train' END FROM models""")

cte("items0", (), """
SELECT vec_id AS item_id, CASE WHEN label < 5 THEN 'alpha' ELSE 'beta' END AS scenario,
       label AS sub, CASE WHEN label < 5 THEN 0 ELSE 1 END AS scenario_ord, label AS sub_ord
FROM embeddings""")

cte("persub", ("items0",), """
SELECT scenario, sub, count(*) AS n_i,
       (sum(count(*)) OVER (PARTITION BY scenario))::BIGINT AS n_scenario,
       count(*) OVER (PARTITION BY scenario) AS n_sub
FROM items0 GROUP BY scenario, sub""")

cte("items", ("items0", "persub"), """
SELECT i.*, (row_number() OVER (ORDER BY scenario_ord, sub_ord, item_id) - 1)::BIGINT AS item_pos,
       p.n_i, p.n_scenario, p.n_sub,
       p.n_scenario::DOUBLE / (p.n_sub * p.n_i)::DOUBLE AS bal_w
FROM items0 i JOIN persub p USING (scenario, sub)""")

cte("test_scores", ("f1_scores", "splits"), """
SELECT s.split_id, f.model_id, f.item_id, f.scenario, f.score
FROM f1_scores f JOIN splits s ON f.model_id = s.model_id AND s.role = 'test'""")

cte("train_scores", ("f1_scores", "splits"), """
SELECT s.split_id, f.model_id, f.item_id, f.scenario, f.score
FROM f1_scores f JOIN splits s ON f.model_id = s.model_id AND s.role = 'train'""")

cte("train_p", ("f1p", "splits"), """
SELECT s.split_id, p.model_id, p.item_id, p.class_id, p.p
FROM f1p p JOIN splits s ON p.model_id = s.model_id AND s.role = 'train'""")

cte("pds", ("train_p",), """
SELECT split_id, item_id, sum(pmax) AS score
FROM (SELECT split_id, item_id, class_id, max(p) AS pmax FROM train_p
      GROUP BY split_id, item_id, class_id)
GROUP BY split_id, item_id""")

cte("truth", ("test_scores", "items", "splits"), """
SELECT t.split_id, t.model_id, i.scenario, avg(i.bal_w * t.score) AS acc, any_value(s.model_pos) AS model_pos
FROM test_scores t JOIN items i USING (item_id)
JOIN splits s ON s.split_id = t.split_id AND s.model_id = t.model_id
GROUP BY t.split_id, t.model_id, i.scenario""")

cte("train_truth", ("train_scores", "items", "splits"), """
SELECT t.split_id, t.model_id, i.scenario, avg(i.bal_w * t.score) AS acc, any_value(s.model_pos) AS model_pos
FROM train_scores t JOIN items i USING (item_id)
JOIN splits s ON s.split_id = t.split_id AND s.model_id = t.model_id
GROUP BY t.split_id, t.model_id, i.scenario""")


def grid_values(grid) -> str:
    return "(SELECT unnest([" + ", ".join(str(int(n)) for n in dict.fromkeys(grid)) + "]) AS n_items)"


def quotas_sql(grid) -> str:
    return f"""
SELECT s.scenario, s.sub, g.n_items, s.sub_rank,
       (floor(g.n_items / s.n_sub) + CASE WHEN s.sub_rank <= g.n_items % s.n_sub THEN 1 ELSE 0 END)::INT AS quota
FROM (SELECT scenario, sub,
             row_number() OVER (PARTITION BY scenario ORDER BY sub_ord, sub) AS sub_rank,
             count(*) OVER (PARTITION BY scenario) AS n_sub
      FROM (SELECT DISTINCT scenario, sub, sub_ord FROM items)) s,
     {grid_values(grid)} g"""


def disagreement_sel_sql(grid, source: str = "pds", high: bool = True, stratified: bool = True,
                         iters: int = 1, name: str | None = None, variant: bool = False) -> str:
    """Selections from a (split_id, [variant,] item_id, score) relation."""
    order = "round(d.score, 12) DESC, i.item_pos ASC" if high else "round(d.score, 12) ASC, i.item_pos DESC"
    vk = "d.variant, " if variant else ""
    base = (("high" if high else "low") + "-disagreement") if name is None else name
    suffix = "" if stratified else "+nonstratified"
    if variant:
        samp = f"'{base}' || CASE WHEN r.variant = 'all' THEN '' ELSE r.variant END || '{suffix}'"
    else:
        samp = f"'{base}{suffix}'"
    if stratified:
        ranked = f"""
SELECT d.split_id, {vk}i.item_id, i.scenario, i.sub, i.item_pos,
       row_number() OVER (PARTITION BY d.split_id, {vk}i.scenario, i.sub ORDER BY {order}) AS rank
FROM {source} d JOIN items i USING (item_id)"""
        joined = f"""
SELECT r.*, q.n_items FROM ({ranked}) r JOIN ({quotas_sql(grid)}) q
  ON r.scenario = q.scenario AND r.sub = q.sub WHERE r.rank <= q.quota"""
    else:
        ranked = f"""
SELECT d.split_id, {vk}i.item_id, i.scenario, i.sub, i.item_pos,
       row_number() OVER (PARTITION BY d.split_id{', d.variant' if variant else ''} ORDER BY {order}) AS rank
FROM {source} d JOIN items i USING (item_id)"""
        joined = f"""
SELECT r.*, g.n_items FROM ({ranked}) r, {grid_values(grid)} g WHERE r.rank <= g.n_items"""
    return f"""
SELECT split_id, sampling, n_items, iter, scenario, item_id, item_pos,
       1.0::DOUBLE / count(*) OVER (PARTITION BY split_id, sampling, n_items, iter, scenario) AS weight
FROM (SELECT r.split_id, {samp} AS sampling, r.n_items, it.iter, r.scenario, r.item_id, r.item_pos
      FROM ({joined}) r, (SELECT range::INT AS iter FROM range({iters})) it)"""


def random_sel_sql(grid, iters: int, split_ids=("iid", "noniid"), seed: int = 0) -> str:
    subs = f"""
SELECT it.iter, s.scenario, s.sub,
       row_number() OVER (PARTITION BY it.iter, s.scenario
                          ORDER BY md5(concat_ws(':', it.iter + {seed}, 'sub', s.scenario, s.sub)), s.sub) AS sub_rank,
       count(*) OVER (PARTITION BY it.iter, s.scenario) AS n_sub
FROM (SELECT DISTINCT scenario, sub FROM items) s, (SELECT range::INT AS iter FROM range({iters})) it"""
    q = f"""
SELECT s.iter, s.scenario, s.sub, g.n_items,
       (floor(g.n_items / s.n_sub) + CASE WHEN s.sub_rank <= g.n_items % s.n_sub THEN 1 ELSE 0 END)::INT AS quota
FROM ({subs}) s, {grid_values(grid)} g"""
    ranked = f"""
SELECT it.iter, i.item_id, i.scenario, i.sub, i.item_pos,
       row_number() OVER (PARTITION BY it.iter, i.scenario, i.sub
                          ORDER BY md5(concat_ws(':', it.iter + {seed}, i.item_id)), i.item_id) AS rank
FROM items i, (SELECT range::INT AS iter FROM range({iters})) it"""
    splits = "(SELECT unnest([" + ", ".join(f"'{s}'" for s in split_ids) + "]) AS split_id)"
    return f"""
SELECT split_id, sampling, n_items, iter, scenario, item_id, item_pos,
       1.0::DOUBLE / count(*) OVER (PARTITION BY split_id, sampling, n_items, iter, scenario) AS weight
FROM (SELECT sp.split_id, 'random' AS sampling, q.n_items, r.iter, r.scenario, r.item_id, r.item_pos
      FROM ({ranked}) r JOIN ({q}) q ON r.iter = q.iter AND r.scenario = q.scenario AND r.sub = q.sub,
      {splits} sp
      WHERE r.rank <= q.quota)"""


def naive_sql(sel: str) -> str:
    return f"""
SELECT t.split_id, t.model_id, s.sampling, s.n_items, s.iter, s.scenario,
       sum(s.weight * t.score) AS acc_hat
FROM test_scores t JOIN ({sel}) s ON t.split_id = s.split_id AND t.item_id = s.item_id
GROUP BY ALL"""


# ----------------------------------------------------------------- F6 estimates
cte("guide10", ("splits",), """
SELECT split_id, model_id FROM (
  SELECT split_id, model_id,
         row_number() OVER (PARTITION BY split_id ORDER BY md5(concat_ws(':', 0, '@10', model_id)), model_id) AS rn
  FROM splits WHERE role = 'train') WHERE rn <= 10""")

cte("pds10", ("train_p", "guide10"), """
SELECT split_id, item_id, sum(pmax) AS score
FROM (SELECT t.split_id, t.item_id, t.class_id, max(t.p) AS pmax
      FROM train_p t JOIN guide10 g ON t.split_id = g.split_id AND t.model_id = g.model_id
      GROUP BY t.split_id, t.item_id, t.class_id)
GROUP BY split_id, item_id""")


def _sel_all_body(grid=(10, 20, 40), iters=3, seed=0) -> str:
    return "\nUNION ALL\n".join([
        random_sel_sql(grid, iters, seed=seed),
        disagreement_sel_sql(grid, "pds", True, True, iters),
        disagreement_sel_sql(grid, "pds", False, True, iters),
        disagreement_sel_sql(grid, "pds10", True, False, iters, name="high-disagreement@10"),
    ])


def register_f6(sfx: str = "", seed: int = 0) -> None:
    """F6 estimates chain; ``sfx`` names a second copy with another random seed."""
    cte(f"sel_all{sfx}", ("items", "pds", "pds10"), _sel_all_body(seed=seed))
    cte(f"naive_est{sfx}", (f"sel_all{sfx}", "test_scores"), f"""
SELECT split_id, model_id, sampling, 'naive' AS estimator, n_items, iter, scenario, acc_hat
FROM ({naive_sql(f'SELECT * FROM sel_all{sfx}')})""")
    cte(f"sigp{sfx}", (f"sel_all{sfx}", "f1p", "splits"), f"""
SELECT s.split_id, s.sampling, s.n_items, s.iter, p.model_id, sp.role, p.item_id, p.class_id, p.p
FROM (SELECT DISTINCT split_id, sampling, n_items, iter, item_id FROM sel_all{sfx}) s
JOIN f1p p ON p.item_id = s.item_id
JOIN splits sp ON sp.split_id = s.split_id AND sp.model_id = p.model_id""")
    cte(f"sig_norms{sfx}", (f"sigp{sfx}",), f"""
SELECT split_id, sampling, n_items, iter, model_id, greatest(sqrt(sum(p * p)), 1e-8) AS nrm
FROM sigp{sfx} GROUP BY split_id, sampling, n_items, iter, model_id""")
    cte(f"knn_est{sfx}", (f"sigp{sfx}", f"sig_norms{sfx}", "train_truth"), f"""
SELECT split_id, model_id, sampling, 'KNN' AS estimator, n_items, iter, scenario, acc AS acc_hat FROM (
  SELECT d.split_id, d.model_id, d.sampling, d.n_items, d.iter, tt.scenario, tt.acc,
         row_number() OVER (PARTITION BY d.split_id, d.model_id, d.sampling, d.n_items, d.iter, tt.scenario
                            ORDER BY round(d.dot / (na.nrm * nb.nrm), 12) DESC, tt.model_pos ASC) AS rn
  FROM (SELECT a.split_id, a.sampling, a.n_items, a.iter, a.model_id, b.model_id AS tr_model,
               sum(a.p * b.p) AS dot
        FROM sigp{sfx} a JOIN sigp{sfx} b
          ON a.split_id = b.split_id AND a.sampling = b.sampling AND a.n_items = b.n_items
         AND a.iter = b.iter AND a.item_id = b.item_id AND a.class_id = b.class_id
        WHERE a.role = 'test' AND b.role = 'train'
        GROUP BY a.split_id, a.sampling, a.n_items, a.iter, a.model_id, b.model_id) d
  JOIN sig_norms{sfx} na ON na.split_id = d.split_id AND na.sampling = d.sampling AND na.n_items = d.n_items
                   AND na.iter = d.iter AND na.model_id = d.model_id
  JOIN sig_norms{sfx} nb ON nb.split_id = d.split_id AND nb.sampling = d.sampling AND nb.n_items = d.n_items
                   AND nb.iter = d.iter AND nb.model_id = d.tr_model
  JOIN train_truth tt ON tt.split_id = d.split_id AND tt.model_id = d.tr_model)
WHERE rn = 1""")
    cte(f"cells{sfx}", (f"sel_all{sfx}",), f"SELECT DISTINCT split_id, n_items, iter FROM sel_all{sfx}")
    cte(f"pknn_est{sfx}", ("pknn", f"cells{sfx}"), f"""
SELECT p.split_id, p.model_id, '-' AS sampling, 'perfect_knn' AS estimator, c.n_items, c.iter,
       p.scenario, p.acc_hat
FROM pknn p JOIN cells{sfx} c ON p.split_id = c.split_id""")
    cte(f"mts_est{sfx}", ("truth", "train_scores", f"cells{sfx}"), f"""
SELECT t.split_id, t.model_id, '-' AS sampling, 'mean_train_score' AS estimator, c.n_items, c.iter,
       t.scenario, m.acc_hat
FROM truth t JOIN (SELECT split_id, avg(score) AS acc_hat FROM train_scores GROUP BY split_id) m
  ON t.split_id = m.split_id
JOIN cells{sfx} c ON t.split_id = c.split_id""")
    cte(f"estimates{sfx}", (f"naive_est{sfx}", f"knn_est{sfx}", f"pknn_est{sfx}", f"mts_est{sfx}"), f"""
SELECT * FROM naive_est{sfx} UNION ALL SELECT * FROM knn_est{sfx}
UNION ALL SELECT * FROM pknn_est{sfx} UNION ALL SELECT * FROM mts_est{sfx}""")
    # leaderboard MAE and Spearman summaries
    per = f"""
SELECT l.*, m.truth, abs(l.est - m.truth) AS err FROM
  (SELECT split_id, sampling, estimator, n_items, model_id, iter, avg(acc_hat) AS est FROM estimates{sfx}
   GROUP BY split_id, sampling, estimator, n_items, model_id, iter) l
JOIN (SELECT split_id, model_id, avg(acc) AS truth FROM truth GROUP BY split_id, model_id) m
  ON l.split_id = m.split_id AND l.model_id = m.model_id"""
    cte(f"lb_per{sfx}", (f"estimates{sfx}", "truth"), per)
    cte(f"lb_mae{sfx}", (f"lb_per{sfx}",), f"""
SELECT split_id, sampling, estimator, n_items, avg(e) AS mae, stddev_pop(e) AS spread FROM (
  SELECT split_id, sampling, estimator, n_items, model_id, avg(err) AS e FROM lb_per{sfx}
  GROUP BY split_id, sampling, estimator, n_items, model_id)
GROUP BY split_id, sampling, estimator, n_items""")
    keys = "split_id, sampling, estimator, n_items, iter"
    cte(f"lb_rank{sfx}", (f"lb_per{sfx}",), f"""
SELECT split_id, sampling, estimator, n_items,
       CASE WHEN isnan(avg(rho)) THEN NULL ELSE avg(rho) END AS rank_corr FROM (
  SELECT {keys}, CASE WHEN sx < 1e-9 OR sy < 1e-9 THEN 'NaN'::DOUBLE ELSE rho END AS rho FROM (
    SELECT {keys}, corr(rx, ry) AS rho, stddev_pop(est) AS sx, stddev_pop(truth) AS sy FROM (
      SELECT *,
        rank() OVER (PARTITION BY {keys} ORDER BY est)
          + (count(*) OVER (PARTITION BY {keys}, est) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY {keys} ORDER BY truth)
          + (count(*) OVER (PARTITION BY {keys}, truth) - 1) / 2.0 AS ry
      FROM lb_per{sfx}) GROUP BY {keys}))
GROUP BY split_id, sampling, estimator, n_items""")


cte("pknn", ("truth", "train_truth"), """
SELECT split_id, model_id, scenario, tr_acc AS acc_hat FROM (
  SELECT t.split_id, t.model_id, t.scenario, r.acc AS tr_acc,
         row_number() OVER (PARTITION BY t.split_id, t.model_id, t.scenario
                            ORDER BY round(abs(r.acc - t.acc), 12), r.model_pos) AS rn
  FROM truth t JOIN train_truth r ON t.split_id = r.split_id AND t.scenario = r.scenario)
WHERE rn = 1""")

register_f6("")
register_f6("_b", seed=100)


# ----------------------------------------------------------------- thresholds, F5
cte("train_soft", ("f1_soft", "splits"), """
SELECT s.split_id, f.model_id, f.item_id, f.scenario, f.score
FROM f1_soft f JOIN splits s ON f.model_id = s.model_id AND s.role = 'train'""")

cte("test_soft", ("f1_soft", "splits"), """
SELECT s.split_id, f.model_id, f.item_id, f.scenario, f.score
FROM f1_soft f JOIN splits s ON f.model_id = s.model_id AND s.role = 'test'""")

cte("grid", (), """
SELECT range::INT AS k,
       CASE WHEN range = 999 THEN 0.99::DOUBLE
            ELSE 0.01::DOUBLE + range::DOUBLE * ((0.99::DOUBLE - 0.01::DOUBLE) / 999.0::DOUBLE) END AS c
FROM range(1000)""")

cte("thresholds", ("train_soft", "grid"), """
SELECT split_id, scenario, k, c AS threshold FROM (
  SELECT e.split_id, e.scenario, e.k, g.c,
         row_number() OVER (PARTITION BY e.split_id, e.scenario ORDER BY e.err, e.k) AS rn
  FROM (SELECT fr.split_id, fr.scenario, fr.k, round(avg(abs(fr.fa - pm.ms)), 12) AS err
        FROM (SELECT t.split_id, t.scenario, t.model_id, g.k,
                     avg(CASE WHEN t.score > g.c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fa
              FROM train_soft t, grid g GROUP BY t.split_id, t.scenario, t.model_id, g.k) fr
        JOIN (SELECT split_id, scenario, model_id, avg(score) AS ms FROM train_soft
              GROUP BY split_id, scenario, model_id) pm
          ON fr.split_id = pm.split_id AND fr.scenario = pm.scenario AND fr.model_id = pm.model_id
        GROUP BY fr.split_id, fr.scenario, fr.k) e
  JOIN grid g ON g.k = e.k) WHERE rn = 1""")

cte("f5", (), """
SELECT m.model_id, e.vec_id AS item_id,
       0.5::DOUBLE + (e.vec_id % 10)::DOUBLE / 10.0::DOUBLE AS a,
       (((e.vec_id * 7) % 41) - 20)::DOUBLE / 10.0::DOUBLE AS b,
       (m.model_id - 30)::DOUBLE / 15.0::DOUBLE AS theta
FROM embeddings e, (SELECT range::INT AS model_id FROM range(60)) m""")

cte("f5p", ("f5",), """
SELECT model_id, item_id, a, b, theta, p,
       CASE WHEN p > ('0x' || substr(md5(concat_ws(':', model_id, item_id)), 1, 8))::BIGINT
                      / 4294967296.0::DOUBLE THEN 1 ELSE 0 END AS resp
FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest(a * theta - b, -30.0::DOUBLE), 30.0::DOUBLE))) AS p
      FROM f5)""")

cte("i6", ("f5p", "items"), """
SELECT scenario, avg(abs(pred - tru)) AS b FROM (
  SELECT f.model_id, i.scenario, avg(i.bal_w * f.p) AS pred, avg(f.resp::DOUBLE) AS tru
  FROM f5p f JOIN items i USING (item_id)
  WHERE f.model_id % 5 = 0 AND i.item_pos % 2 = 1
  GROUP BY f.model_id, i.scenario) GROUP BY scenario""")


# ----------------------------------------------------------------- result tables
cte("long_a", ("lb_mae",), "SELECT split_id, n_items, sampling, estimator, mae AS value FROM lb_mae")
cte("long_b", ("lb_mae_b",), "SELECT split_id, n_items, sampling, estimator, mae AS value FROM lb_mae_b")
cte("rlong_a", ("lb_rank",), "SELECT split_id, n_items, sampling, estimator, rank_corr AS value FROM lb_rank")
cte("rlong_b", ("lb_rank_b",), "SELECT split_id, n_items, sampling, estimator, rank_corr AS value FROM lb_rank_b")

cte("meta", ("lb_mae",), r"""
SELECT sampling,
       CASE WHEN contains(sampling, 'disagreement') THEN
            CASE WHEN contains(sampling, '@') THEN regexp_extract(sampling, '@(\d+)', 1) ELSE 'all' END END
         AS guiding_models,
       CASE WHEN contains(sampling, 'disagreement') THEN
            CASE WHEN contains(sampling, 'high') THEN 'highest' ELSE 'lowest' END END AS pds_type,
       CASE WHEN contains(sampling, 'disagreement') THEN NOT contains(sampling, '+nonstratified') END
         AS stratified
FROM (SELECT DISTINCT sampling FROM lb_mae)""")


def best_sql(long: str, key: str = "pds_type", lower: bool = True) -> str:
    agg = "min" if lower else "max"
    return f"""
SELECT l.split_id, l.n_items, m.{key}::VARCHAR AS row_label, l.estimator, {agg}(l.value) AS value
FROM {long} l JOIN meta m USING (sampling) WHERE m.{key} IS NOT NULL
GROUP BY l.split_id, l.n_items, m.{key}, l.estimator
UNION ALL
SELECT l.split_id, l.n_items, l.sampling, l.estimator, l.value
FROM {long} l JOIN meta m USING (sampling) WHERE m.{key} IS NULL"""


def report_sql(src: str, tgt: str, key: str = "pds_type", lower: bool = True) -> str:
    order = "ASC" if lower else "DESC"
    return f"""
SELECT p.split_id, p.n_items, p.grp AS row_label, p.estimator, t.value FROM (
  SELECT split_id, n_items, grp, estimator, sampling FROM (
    SELECT l.*, m.{key}::VARCHAR AS grp,
           row_number() OVER (PARTITION BY l.split_id, l.n_items, m.{key}, l.estimator
                              ORDER BY l.value {order}, l.sampling) AS rn
    FROM {src} l JOIN meta m USING (sampling) WHERE m.{key} IS NOT NULL AND l.value IS NOT NULL)
  WHERE rn = 1) p
LEFT JOIN {tgt} t ON t.split_id = p.split_id AND t.n_items = p.n_items AND t.sampling = p.sampling
 AND t.estimator = p.estimator
UNION ALL
SELECT l.split_id, l.n_items, l.sampling, l.estimator, l.value
FROM {tgt} l JOIN meta m USING (sampling) WHERE m.{key} IS NULL"""


def fit_sql(src_best: str, tgt_best: str, cands=("naive", "KNN"), lower: bool = True,
            keep: bool = False) -> str:
    worst = "'inf'::DOUBLE" if lower else "'-inf'::DOUBLE"
    order = "ASC" if lower else "DESC"
    inl = ", ".join(f"'{c}'" for c in cands)
    idx = "CASE estimator " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cands)) + " END"
    keep_rows = f"SELECT * FROM ({tgt_best})" + ("" if keep else f" WHERE estimator NOT IN ({inl})")
    return f"""
{keep_rows}
UNION ALL
SELECT p.split_id, p.n_items, p.row_label, 'fit' AS estimator, t.value FROM (
  SELECT split_id, n_items, row_label, estimator FROM (
    SELECT *, row_number() OVER (PARTITION BY split_id, n_items, row_label
                                 ORDER BY coalesce(value, {worst}) {order}, {idx}) AS rn
    FROM ({src_best}) WHERE estimator IN ({inl})) WHERE rn = 1) p
LEFT JOIN ({tgt_best}) t ON t.split_id = p.split_id AND t.n_items = p.n_items
 AND t.row_label = p.row_label AND t.estimator = p.estimator"""


# ----------------------------------------------------------------- raw logs (F4), F2
cte("f4a", ("f1", "f1_scores"), """
SELECT a.model_id, a.sub, a.item_id, s.score, a.n_answers, a.logit_sum,
       (row_number() OVER (PARTITION BY a.model_id, a.sub ORDER BY a.item_id) - 1)::INT AS item_no
FROM (SELECT model_id, item_id, any_value(sub) AS sub, count(*)::INT AS n_answers,
             sum(round(logit, 6)) AS logit_sum
      FROM f1 WHERE model_id BETWEEN 0 AND 39 AND (sub <> 0 OR class_id < 3)
        AND NOT (model_id % 10 = 7 AND sub = 3)
      GROUP BY model_id, item_id) a
JOIN f1_scores s ON s.model_id = a.model_id AND s.item_id = a.item_id""")

cte("f4_cells", ("f1_scores",), """
SELECT model_id, sub, CASE WHEN model_id <= 39 THEN 'A' ELSE 'B' END AS snapshot,
       CASE WHEN model_id % 10 = 7 AND sub = 3 THEN 0 ELSE count(*) END::INT AS n_items,
       CASE WHEN model_id % 10 = 7 AND sub = 3 THEN NULL
            WHEN model_id <= 39 THEN sum(score)
            ELSE sum(0.25::DOUBLE + score * 0.5::DOUBLE) END AS score_sum
FROM f1_scores GROUP BY model_id, sub""")

cte("f2", (), """
SELECT l_suppkey::BIGINT AS model_id, l_partkey::BIGINT AS item_id, p_brand AS scenario, p_type AS sub,
       round(max(l_discount) * 10, 6) AS score, min(l_shipdate) AS run_ts, count(*) AS n_obs
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_suppkey, l_partkey, p_brand, p_type""")

cte("f2_metric", ("f2",), """
SELECT model_id, sub,
       CASE WHEN contains(sub, 'arc') THEN 'acc_norm' WHEN contains(sub, 'hellaswag') THEN 'acc_norm'
            WHEN contains(sub, 'truthfulqa') THEN 'mc2' ELSE 'acc' END AS metric,
       count(*) AS n, sum(score) AS s_acc, sum(round(score * 0.9, 6)) AS s_norm
FROM f2 GROUP BY model_id, sub""")


cte("f3", (), """
SELECT event_id, ts, user_id AS model_id, json_extract_string(props, '$.k')::INT AS item_id,
       round(least(value, 100.0) / 100.0, 6) AS score FROM events""")


cte("sp_items", ("f2",), """
SELECT i.item_id, i.scenario, i.sub, p.n_i, p.n_scenario, p.n_sub,
       (row_number() OVER (ORDER BY c.scenario_ord, c.sub_ord, i.item_id) - 1)::BIGINT AS item_pos,
       p.n_scenario::DOUBLE / (p.n_sub * p.n_i)::DOUBLE AS bal_w
FROM (SELECT DISTINCT item_id, scenario, sub FROM f2) i
JOIN (SELECT scenario, sub, dense_rank() OVER (ORDER BY scenario) - 1 AS scenario_ord,
             dense_rank() OVER (PARTITION BY scenario ORDER BY sub) - 1 AS sub_ord
      FROM (SELECT DISTINCT scenario, sub FROM f2)) c USING (scenario, sub)
JOIN (SELECT scenario, sub, count(*) AS n_i,
             (sum(count(*)) OVER (PARTITION BY scenario))::BIGINT AS n_scenario,
             count(*) OVER (PARTITION BY scenario) AS n_sub
      FROM (SELECT DISTINCT item_id, scenario, sub FROM f2) GROUP BY scenario, sub) p
  USING (scenario, sub)""")
