"""SQL twins of the queries in ``proofs``."""

from __future__ import annotations

from chromaspark.plans.oracles import (
    CLF_KNN, CLF_SPLIT, DS, FEATS, REG_KNN, REG_SPLIT, REPORT, RUNS, knn, knn_folds, r6, zero,
)

K_VALUES = (3, 5, 7)
Y = '"Retention_Time_min"'


def _metrics() -> str:
    """CTEs ending in ``mets``: test metrics of the neighbour models of each size."""
    parts = []
    for i, k in enumerate(K_VALUES):
        e = "(t.y - s.p)"
        parts.append(f"""SELECT 'regression' AS task, 'KNN{k}' AS model, {i} AS pos, sqrt(avg({e} * {e})) AS rmse,
          1.0 - avg({e} * {e}) / var_pop(t.y) AS r2, avg(abs({e})) AS mae, CAST(NULL AS DOUBLE) AS accuracy
          FROM (SELECT run_id, {Y} AS y FROM rtest) t JOIN r_qmap m ON t.run_id = m.run_id
          JOIN (SELECT qid, avg(y) AS p FROM r_nn WHERE rk <= {k} GROUP BY qid) s ON s.qid = m.qid""")
        parts.append(f"""SELECT 'classification', 'KNN{k}', {i}, NULL, NULL, NULL, avg(CASE WHEN t.code = s.code THEN 1.0 ELSE 0.0 END)
          FROM ctest t JOIN c_qmap m ON t.run_id = m.run_id JOIN (
            SELECT qid, code FROM (SELECT qid, y AS code, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, y) AS rn
              FROM c_nn WHERE rk <= {k} GROUP BY qid, y) WHERE rn = 1) s ON s.qid = m.qid""")
    return f"""{DS}, {REG_SPLIT}, {CLF_SPLIT},
rtrain AS (SELECT * FROM rsplit WHERE NOT is_test), rtest AS (SELECT * FROM rsplit WHERE is_test),
ctrain AS (SELECT * FROM csplit WHERE NOT is_test), ctest AS (SELECT * FROM csplit WHERE is_test),
{knn('rtrain', 'rtest', Y, max(K_VALUES), 'r_')}, {knn('ctrain', 'ctest', 'code', max(K_VALUES), 'c_')},
mets AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE task WHEN 'regression' THEN rmse ELSE -accuracy END, pos) AS rank FROM mets)"""


def _moments(rows: str, digits: int = 4) -> str:
    parts = [f"SELECT '{f}' AS feature, round(avg({zero(f)} * {Y}), {digits}) AS moment FROM {rows}" for f in FEATS]
    return " UNION ALL ".join(parts)


def _pca(ending: str) -> str:
    """Closed form of two components; the loading of larger size is positive."""
    return f"""WITH {DS}, x AS (SELECT run_id, {zero('LogP')} AS u, {zero('pH')} AS v FROM ds),
c AS (SELECT var_samp(u) AS a, var_samp(v) AS d, covar_samp(u, v) AS b, avg(u) AS mu, avg(v) AS mv FROM x),
l AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS l2 FROM c),
w AS (SELECT *, CASE WHEN a >= d THEN l1 - d ELSE b END AS p, CASE WHEN a >= d THEN b ELSE l1 - a END AS q FROM l),
o AS (SELECT *, p / sqrt(p * p + q * q) AS x1, q / sqrt(p * p + q * q) AS y1 FROM w),
s AS (SELECT *, CASE WHEN (CASE WHEN abs(x1) >= abs(y1) THEN x1 ELSE y1 END) < 0 THEN -1.0 ELSE 1.0 END AS g1,
             CASE WHEN (CASE WHEN abs(y1) >= abs(x1) THEN -y1 ELSE x1 END) < 0 THEN -1.0 ELSE 1.0 END AS g2 FROM o),
fits AS (SELECT l1, l2, mu, mv, g1 * x1 AS x1, g1 * y1 AS y1, g2 * -y1 AS x2, g2 * x1 AS y2 FROM s)
{ending}"""


def oracles() -> dict[str, str]:
    mets, distinct = _metrics(), f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(zero(f) for f in FEATS)} FROM ds))"
    e = "(actual - prediction)"
    rmse, r2, mae = f"sqrt(avg({e} * {e}))", f"1.0 - avg({e} * {e}) / var_pop(actual)", f"avg(abs({e}))"
    reg_train = f"{DS}, {REG_SPLIT}, rtrain AS (SELECT * FROM rsplit WHERE NOT is_test)"
    energy = r6(" + ".join(f"var_pop({zero(f)})" for f in FEATS))
    shares = f"""WITH {DS}, {CLF_SPLIT}, t AS (SELECT * FROM csplit WHERE NOT is_test)
      SELECT l.code, round(count(t.run_id) / (SELECT count(*) FROM t), {{digits}}) AS share FROM labels l LEFT JOIN t ON t.code = l.code GROUP BY l.code"""
    both = f"{REG_KNN}, {REPORT[len(DS) + 2:]}"
    macro = "avg(p)", "avg(r)", "avg(f)", "CAST(sum(support) AS BIGINT)"
    accuracy = "sum(hit) / sum(support)"
    return {
        "grid_means": f"""WITH s AS ({knn_folds(rounded=False)}), m AS (SELECT grid_id, avg(score) AS a FROM s GROUP BY grid_id)
          SELECT grid_id, {r6('a')} AS mean_score, row_number() OVER (ORDER BY a, grid_id) = 1 AS is_best FROM m""",
        "read_dispatch": f"""WITH {RUNS}, n AS (SELECT count(*) AS n_rows, count({Y}) AS n_known FROM runs)
          SELECT n.*, suffix FROM n, (VALUES ('CSV'), ('Parquet'), ('json')) AS t(suffix)""",
        "two_tables": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders",
        "task_guards": f"""WITH {DS} SELECT 'retention' AS guard, count({Y}) > 0 AS passed FROM ds UNION ALL SELECT 'absent', false
          UNION ALL SELECT 'classes', min(n) >= 2 FROM (SELECT count(*) AS n FROM ds GROUP BY code)""",
        "knn_rank": f"WITH {mets} SELECT task, model, rank FROM placed",
        "knn_bars": f"""WITH {mets} SELECT task, model, 'rmse' AS metric, {r6('rmse')} AS value FROM mets WHERE rmse IS NOT NULL
          UNION ALL SELECT task, model, 'r2', {r6('r2')} FROM mets WHERE r2 IS NOT NULL
          UNION ALL SELECT task, model, 'accuracy', {r6('accuracy')} FROM mets WHERE accuracy IS NOT NULL""",
        "model_metrics": f"""WITH {mets} SELECT task, model, {r6('rmse')} AS rmse, {r6('r2')} AS r2, {r6('mae')} AS mae,
          {r6('accuracy')} AS accuracy FROM placed WHERE rank = 1""",
        # the seeded sample of two of the three points is the first and the last
        "random_grid_scores": f"""WITH s AS ({knn_folds()}) SELECT CAST(3 + 2 * grid_id AS BIGINT) AS n_neighbors, fold, score
          FROM s WHERE grid_id IN (0, 2)""",
        "session_knn": f"WITH {REG_KNN} SELECT run_id, {r6('prediction')} AS prediction FROM rscored",
        "result_files": f"""WITH {both} SELECT 'KNN' AS model, {r6(rmse)} AS rmse, {r6(r2)} AS r2, {r6(mae)} AS mae, CAST(NULL AS DOUBLE) AS accuracy,
            CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS support FROM rscored
          UNION ALL SELECT 'KNN', NULL, NULL, NULL, {r6(accuracy)}, {r6(macro[0])}, {r6(macro[1])}, {r6(macro[2])}, CAST({macro[3]} AS DOUBLE) FROM prf""",
        "report_metrics": f"""WITH {both} SELECT 'regression models' AS section,
            printf('KNN | %.4f | %.4f | %.4f | {{''n_neighbors'': 5}}', {rmse}, {r2}, {mae}) AS text FROM rscored
          UNION ALL SELECT 'classification models', printf('KNN | %.4f | %.4f | %.4f | %.4f | %d | {{''n_neighbors'': 5}}',
            {accuracy}, {macro[0]}, {macro[1]}, {macro[2]}, {macro[3]}) FROM prf""",
        "no_condition": f'WITH {DS} SELECT "Buffer_%" AS org, "Organic_%" AS buf, "Separation_Quality" AS label FROM ds WHERE "Separation_Quality" IS NULL',
        "qsrr_moments": f"WITH {DS}, known AS (SELECT * FROM ds WHERE {Y} IS NOT NULL) {_moments('known')}",
        "ridge_moments": f"WITH {reg_train} {_moments('rtrain')}",
        "lasso_moments": f"WITH {reg_train} {_moments('rtrain')}",
        "logistic_shares": shares.format(digits=3),
        "tree_shares": shares.format(digits=6),
        "tree_leaf_means": f"WITH {reg_train} SELECT count(*) AS n, {r6(f'avg({Y})')} AS mean, CAST(0 AS BIGINT) AS wrong_leaves FROM rtrain",
        "boosting_mean": f"WITH {reg_train} SELECT count(*) AS n, round(avg({Y}), 4) AS mean FROM rtrain",
        "pca_two_variance": _pca(f"""SELECT 'PC1' AS component, {r6('l1')} AS variance, {r6('l1 / (l1 + l2)')} AS ratio FROM fits
          UNION ALL SELECT 'PC2', {r6('l2')}, {r6('l2 / (l1 + l2)')} FROM fits"""),
        "pca_two_loadings": _pca(f"""SELECT 'LogP' AS feature, 'PC1' AS component, {r6('x1')} AS loading FROM fits UNION ALL
          SELECT 'pH', 'PC1', {r6('y1')} FROM fits UNION ALL SELECT 'LogP', 'PC2', {r6('x2')} FROM fits UNION ALL SELECT 'pH', 'PC2', {r6('y2')} FROM fits"""),
        "pca_two_scores": _pca(f"""SELECT run_id, {r6('(u - mu) * x1 + (v - mv) * y1')} AS pc1,
          {r6('(u - mu) * x2 + (v - mv) * y2')} AS pc2 FROM x, fits"""),
        "ward_energy": f"WITH {DS} SELECT {distinct} - 1 AS n_merges, {energy} AS energy FROM ds",
        "ward_label_energy": f"WITH {DS} SELECT count(*) AS n, {energy} AS energy FROM ds",
        "tsne_graph_facts": f"WITH {DS} SELECT {distinct} AS nodes, 1.0 AS total, CAST(0 AS BIGINT) AS odd_edges",
        "umap_graph_facts": f"WITH {DS} SELECT {distinct} AS nodes, CAST(0 AS BIGINT) AS odd_edges",
    }
