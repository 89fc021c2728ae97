"""SQL twins of the registered queries, for a second engine over the same tables."""

from __future__ import annotations

FEATS = ["Buffer_%", "Organic_%", "MolWt", "LogP", "TPSA", "HBD", "HBA", "pH"]

RUNS = """
base AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, min(l_quantity) AS qty,
         min(l_extendedprice) AS price, min(l_returnflag) AS rf, min(l_linestatus) AS ls
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), k AS (
  SELECT b.*, p.p_name, CAST(1 + p.p_size % 12 AS INT) AS n_c, CAST(p.p_partkey % 4 AS INT) AS fam
  FROM base b JOIN part p ON b.partkey = p.p_partkey
), runs AS (
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS run_id,
       concat(p_name, ' #', CAST(partkey AS STRING)) AS "Compound",
       CASE WHEN partkey % 41 = 0 THEN NULL
            WHEN partkey % 37 = 0 THEN 'not_a_smiles'
            ELSE concat(repeat('C', n_c),
                 CASE fam WHEN 0 THEN 'O' WHEN 1 THEN 'N' WHEN 2 THEN 'C(=O)O' ELSE 'c1ccccc1' END) END AS "SMILES",
       CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE round(price / 10000.0, 3) END AS "Retention_Time_min",
       CASE WHEN rf='A' AND ls='F' THEN 'Completely separated'
            WHEN rf='A' AND ls='O' THEN 'Switching-fully separated'
            WHEN rf='N' AND ls='F' THEN 'Switching-partialy separated'
            WHEN rf='N' AND ls='O' THEN 'Partialy separated'
            WHEN rf='R' AND ls='F' THEN 'Overlaping' ELSE NULL END AS "Separation_Quality",
       CAST(10 * ceil(qty / 10.0) AS DOUBLE) AS "Buffer_%",
       CAST((CASE WHEN partkey % 10 = 0 THEN 95 ELSE 100 END) - 10 * ceil(qty / 10.0) AS DOUBLE) AS "Organic_%",
       CASE WHEN l_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(CAST(2.0 + 0.5 * l_linenumber AS DOUBLE) AS STRING) END AS "pH"
FROM k
)"""

DESCRIPTORS = """
n AS (SELECT * FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS t(n_c)),
f AS (SELECT * FROM (VALUES
  ('O', 18.015, -0.78, 20.23, 1, 1),
  ('N', 17.031, -0.82, 26.02, 1, 1),
  ('C(=O)O', 46.025, -0.30, 37.30, 1, 2),
  ('c1ccccc1', 78.114, 1.69, 0.0, 0, 0)) AS t(sfx, mw0, lp0, tpsa, hbd, hba)),
descriptors AS (
SELECT concat(repeat('C', n_c), sfx) AS "SMILES",
       CAST(round(CAST(mw0 AS DOUBLE) + CAST(14.027 AS DOUBLE) * n_c, 3) AS DOUBLE) AS "MolWt",
       CAST(round(CAST(lp0 AS DOUBLE) + CAST(0.39 AS DOUBLE) * n_c, 3) AS DOUBLE) AS "LogP",
       CAST(tpsa AS DOUBLE) AS "TPSA", CAST(hbd AS INT) AS "HBD", CAST(hba AS INT) AS "HBA"
FROM n, f
)"""

DS = f"""{RUNS}, {DESCRIPTORS},
joined AS (
SELECT r.run_id, r."Compound", r."SMILES", r."Retention_Time_min",
       coalesce(r."Separation_Quality", 'No data') AS "Separation_Quality",
       r."Buffer_%", r."Organic_%", TRY_CAST(r."pH" AS DOUBLE) AS "pH",
       coalesce(d."MolWt", 0) AS "MolWt", coalesce(d."LogP", 0) AS "LogP", coalesce(d."TPSA", 0) AS "TPSA",
       CAST(coalesce(d."HBD", 0) AS BIGINT) AS "HBD", CAST(coalesce(d."HBA", 0) AS BIGINT) AS "HBA"
FROM runs r LEFT JOIN descriptors d ON r."SMILES" = d."SMILES"
), labels AS (
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT "Separation_Quality" AS label FROM joined)
), ds AS (
SELECT j.*, l.code FROM joined j JOIN labels l ON j."Separation_Quality" = l.label
)"""

PRIORITY = """prio AS (SELECT l.code, p.label, p.priority FROM (VALUES ('Completely separated', 1),
 ('Switching-fully separated', 2), ('Switching-partialy separated', 3), ('Partialy separated', 4),
 ('Overlaping', 5), ('No data', 6)) AS p(label, priority) JOIN labels l ON l.label = p.label)"""


def h(seed: int, key: str = "run_id") -> str:
    return f"CAST(('0x' || substring(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


def q(name: str) -> str:
    return f'"{name}"'


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def zero(f: str, alias: str = "") -> str:
    return f'coalesce(CAST({alias}"{f}" AS DOUBLE), 0.0)'


REG_SPLIT = f"""known AS (SELECT * FROM ds WHERE "Retention_Time_min" IS NOT NULL),
rsplit AS (SELECT *, row_number() OVER (ORDER BY {h(42)}, run_id)
  <= (SELECT ceil(0.2 * count(*) - 1e-9) FROM known) AS is_test FROM known)"""

CLF_SPLIT = f"""cc AS (SELECT code, count(*) AS n FROM ds GROUP BY code),
tot AS (SELECT sum(n) AS total, ceil(0.2 * sum(n) - 1e-9) AS wanted FROM cc),
ex AS (SELECT code, n * wanted / total AS x, floor(n * wanted / total + 1e-9) AS fl FROM cc, tot),
quota AS (SELECT code, fl + CASE WHEN row_number() OVER (ORDER BY x - fl DESC, code)
   <= (SELECT any_value(wanted) FROM tot) - (SELECT sum(fl) FROM ex) THEN 1 ELSE 0 END AS quota FROM ex),
csplit AS (SELECT d.*, row_number() OVER (PARTITION BY d.code ORDER BY {h(42)}, run_id) <= quota.quota AS is_test
  FROM ds d JOIN quota ON d.code = quota.code)"""


def knn(train: str, query: str, y: str, k: int, tag: str = "", feats: list[str] = FEATS) -> str:
    """CTEs ending in ``<tag>nn``: the k nearest train rows of each distinct query vector."""
    fx = [f"f{i}" for i in range(len(feats))]
    cols = ", ".join(f"{zero(f)} AS {a}" for f, a in zip(feats, fx))
    keys = ", ".join(fx)
    stats = ", ".join(f"stddev_pop({a}) AS s{i}" for i, a in enumerate(fx))
    d2 = " + ".join(
        f"(CASE WHEN s.s{i} > 0 THEN ((u.{a} - t.{a}) / s.s{i}) * ((u.{a} - t.{a}) / s.s{i}) ELSE 0 END)"
        for i, a in enumerate(fx)
    )
    same = " AND ".join(f"r.{a} = v.{a}" for a in fx)
    return f"""
{tag}tr AS (SELECT run_id, {y} AS y, {cols} FROM {train}),
{tag}qr AS (SELECT run_id, {cols} FROM {query}),
{tag}st AS (SELECT {stats} FROM {tag}tr),
{tag}tv AS (SELECT {keys}, min(run_id) AS id FROM {tag}tr GROUP BY {keys}),
{tag}qv AS (SELECT {keys}, min(run_id) AS id FROM {tag}qr GROUP BY {keys}),
{tag}near AS (
  SELECT qid, tid, d2 FROM (
    SELECT qid, tid, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM (
      SELECT u.id AS qid, t.id AS tid, round({d2}, 9) AS d2 FROM {tag}qv u, {tag}tv t, {tag}st s)) WHERE rn <= {k}),
{tag}mem AS (
  SELECT tid, member, y FROM (
    SELECT v.id AS tid, r.run_id AS member, r.y, row_number() OVER (PARTITION BY v.id ORDER BY r.run_id) AS rn
    FROM {tag}tr r JOIN {tag}tv v ON {same}) WHERE rn <= {k}),
{tag}nn AS (
  SELECT qid, member, y, d2, rk FROM (
    SELECT n.qid, m.member, m.y, n.d2, row_number() OVER (PARTITION BY n.qid ORDER BY n.d2, m.member) AS rk
    FROM {tag}near n JOIN {tag}mem m ON n.tid = m.tid) WHERE rk <= {k}),
{tag}qmap AS (SELECT r.run_id, v.id AS qid FROM {tag}qr r JOIN {tag}qv v ON {same})"""


def regress(tag: str = "") -> str:
    return f"{tag}said AS (SELECT qid, avg(y) AS prediction FROM {tag}nn GROUP BY qid)"


def classify(tag: str = "") -> str:
    return f"""{tag}votes AS (SELECT qid, y AS code, count(*) AS votes FROM {tag}nn GROUP BY qid, y),
{tag}said AS (SELECT qid, code AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, code) AS rn FROM {tag}votes) WHERE rn = 1)"""


REG_KNN = f"""{DS}, {REG_SPLIT},
rtrain AS (SELECT * FROM rsplit WHERE NOT is_test), rtest AS (SELECT * FROM rsplit WHERE is_test),
{knn('rtrain', 'rtest', '"Retention_Time_min"', 5, 'r_')}, {regress('r_')},
rscored AS (SELECT t.run_id, t."Retention_Time_min" AS actual, s.prediction FROM rtest t
  JOIN r_qmap m ON t.run_id = m.run_id JOIN r_said s ON m.qid = s.qid)"""

CLF_KNN = f"""{DS}, {CLF_SPLIT},
ctrain AS (SELECT * FROM csplit WHERE NOT is_test), ctest AS (SELECT * FROM csplit WHERE is_test),
{knn('ctrain', 'ctest', 'code', 5, 'c_')}, {classify('c_')},
cscored AS (SELECT t.run_id, t.code AS actual, s.prediction, m.qid FROM ctest t
  JOIN c_qmap m ON t.run_id = m.run_id JOIN c_said s ON m.qid = s.qid)"""

CLF_ACCURACY = f"(WITH {CLF_KNN} SELECT {r6('avg(CASE WHEN actual = prediction THEN 1.0 ELSE 0.0 END)')} FROM cscored)"
REG_R2 = f"(WITH {REG_KNN} SELECT {r6('1.0 - avg((actual - prediction) * (actual - prediction)) / var_pop(actual)')} FROM rscored)"

CONDITIONS = """conds AS (SELECT DISTINCT "pH" AS ph, "Buffer_%" AS org, 100.0 - "Buffer_%" AS buf FROM ds
  WHERE "pH" IS NOT NULL AND "Buffer_%" IS NOT NULL AND "Organic_%" = 100.0 - "Buffer_%")"""

COND_ROWS = """condq AS (SELECT row_number() OVER (ORDER BY ph, org) AS run_id, ph AS "pH", org AS "Buffer_%",
  buf AS "Organic_%", 0.0 AS "MolWt", 0.0 AS "LogP", 0.0 AS "TPSA", 0.0 AS "HBD", 0.0 AS "HBA" FROM conds)"""

CONDS_SCORED = f"""{DS}, {CLF_SPLIT}, {PRIORITY}, {CONDITIONS}, {COND_ROWS},
ctrain AS (SELECT * FROM csplit WHERE NOT is_test),
{knn('ctrain', 'condq', 'code', 5, 'c_')}, {classify('c_')},
scored AS (SELECT c."pH" AS ph, c."Buffer_%" AS org, c."Organic_%" AS buf, s.prediction AS code
  FROM condq c JOIN c_qmap m ON c.run_id = m.run_id JOIN c_said s ON m.qid = s.qid)"""

COMPOUNDS = """comp AS (SELECT d.* FROM descriptors d WHERE d."SMILES" IN (SELECT DISTINCT "SMILES" FROM runs)),
compq AS (SELECT row_number() OVER (ORDER BY "SMILES") AS run_id, "SMILES", "MolWt", "LogP", "TPSA", "HBD", "HBA",
  50.0 AS "Buffer_%", 50.0 AS "Organic_%", 7.0 AS "pH" FROM comp)"""

SINGLE = """fit AS (SELECT regr_slope("Retention_Time_min", CAST("MolWt" AS DOUBLE)) AS b,
  regr_intercept("Retention_Time_min", CAST("MolWt" AS DOUBLE)) AS a,
  regr_r2("Retention_Time_min", CAST("MolWt" AS DOUBLE)) AS r2, count("Retention_Time_min") AS n FROM ds)"""

TWO = """two AS (SELECT regr_sxx(y, u) AS suu, regr_sxx(y, v) AS svv, regr_sxy(v, u) AS suv, regr_sxy(y, u) AS suy,
  regr_sxy(y, v) AS svy, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, CAST(count(*) AS DOUBLE) AS n FROM
  (SELECT "Retention_Time_min" AS y, CAST("LogP" AS DOUBLE) AS u, coalesce("pH", 0.0) AS v FROM ds
   WHERE "Retention_Time_min" IS NOT NULL))"""


def _corr(cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            x, y = f'CAST("{a}" AS DOUBLE)', f'CAST("{b}" AS DOUBLE)'
            # One order of the arguments per pair, so both halves are the same number.
            if cols.index(a) > cols.index(b):
                x, y = y, x
            r = f"regr_sxy({y}, {x}) / nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0)"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, {r6(r)} AS r FROM ds")
    return f"WITH {DS} " + " UNION ALL ".join(parts)


def _gram(cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, {r6(f'regr_sxy({zero(b)}, {zero(a)}) / count(*)')} AS value_per_run FROM ds")
    return f"WITH {DS} " + " UNION ALL ".join(parts)


def _standardize() -> str:
    stats = ", ".join(f"avg({zero(f)}) AS m{i}, stddev_pop({zero(f)}) AS s{i}" for i, f in enumerate(FEATS))
    cols = ", ".join(
        f"{r6(f'CASE WHEN s.s{i} > 0 THEN ({zero(f)} - s.m{i}) / s.s{i} ELSE 0.0 END')} AS \"{f}\"" for i, f in enumerate(FEATS)
    )
    return f"WITH {DS}, s AS (SELECT {stats} FROM ds) SELECT run_id, {cols} FROM ds, s"


REPORT = f"""{CLF_KNN},
per AS (SELECT l.label, l.code,
  coalesce(sum(CASE WHEN s.actual = l.code AND s.prediction = l.code THEN 1 END), 0) AS hit,
  coalesce(sum(CASE WHEN s.prediction = l.code THEN 1 END), 0) AS named,
  coalesce(sum(CASE WHEN s.actual = l.code THEN 1 END), 0) AS support
  FROM labels l, cscored s GROUP BY l.label, l.code),
prf AS (SELECT label, hit, support, CASE WHEN named > 0 THEN hit / named ELSE 0.0 END AS p,
  CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r,
  CASE WHEN named + support > 0 THEN 2.0 * hit / (named + support) ELSE 0.0 END AS f FROM per)"""

CURVES = f"""{CLF_KNN},
share AS (SELECT s.run_id, l.code AS class, s.actual = l.code AS positive, coalesce(v.votes, 0) / 5.0 AS score
  FROM cscored s JOIN labels l ON true LEFT JOIN c_votes v ON v.qid = s.qid AND v.code = l.code),
sc AS (SELECT class, score, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN positive THEN 0 ELSE 1 END) AS neg FROM share GROUP BY class, score),
cum AS (SELECT class, score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
  sum(pos) OVER (PARTITION BY class) AS tp, sum(neg) OVER (PARTITION BY class) AS tn
  FROM sc WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""



def knn_folds(k_values: tuple[int, ...] = (3, 5, 7), folds: int = 3, rounded: bool = True) -> str:
    """Scores of every k on every fold of the regression training rows."""
    head = f"""{DS}, {REG_SPLIT},
folded AS (SELECT *, {h(43)} % {folds} AS fold FROM rsplit WHERE NOT is_test)"""
    ctes, picks = [head], []
    for f in range(folds):
        ctes.append(f"a{f} AS (SELECT * FROM folded WHERE fold <> {f}), b{f} AS (SELECT * FROM folded WHERE fold = {f})")
        ctes.append(knn(f"a{f}", f"b{f}", '"Retention_Time_min"', max(k_values), f"k{f}_"))
        for i, k in enumerate(k_values):
            picks.append(f"""SELECT {i} AS grid_id, {f} AS fold, sqrt(avg((t.y - s.p) * (t.y - s.p))) AS score FROM
 (SELECT run_id, "Retention_Time_min" AS y FROM b{f}) t JOIN k{f}_qmap m ON t.run_id = m.run_id
 JOIN (SELECT qid, avg(y) AS p FROM k{f}_nn WHERE rk <= {k} GROUP BY qid) s ON s.qid = m.qid""")
    return f"WITH {', '.join(ctes)} SELECT CAST(grid_id AS BIGINT) AS grid_id, CAST(fold AS BIGINT) AS fold, {r6('score') if rounded else 'score'} AS score FROM ({' UNION ALL '.join(picks)})"


def oracles() -> dict[str, str]:
    feats = ", ".join(f"{zero(f)} AS \"{f}\"" for f in FEATS)
    desc = '"MolWt", "LogP", "TPSA", "HBD", "HBA"'
    cut = "CASE WHEN length({s}) > 20 THEN concat(substring({s}, 1, 20), '...') ELSE {s} END"
    pv = ", ".join(
        f"{cut.format(s=f'CAST({q(c)} AS VARCHAR)')} AS {q(c)}"
        for c in ("Compound", "SMILES", "Separation_Quality", "pH")
    )
    e = "(actual - prediction)"
    suggest = f"""WITH {DS}, {CLF_SPLIT}, {REG_SPLIT}, {PRIORITY}, {CONDITIONS}, {COMPOUNDS},
ctrain AS (SELECT * FROM csplit WHERE NOT is_test), rtrain AS (SELECT * FROM rsplit WHERE NOT is_test),
cx AS (SELECT row_number() OVER (ORDER BY c."SMILES", ph, org) AS run_id, c."SMILES", c."MolWt", c."LogP", c."TPSA",
  c."HBD", c."HBA", ph AS "pH", org AS "Buffer_%", buf AS "Organic_%" FROM comp c, conds),
{knn('ctrain', 'cx', 'code', 5, 'c_')}, {classify('c_')},
ranked AS (SELECT x.*, p.label, p.priority, row_number() OVER (PARTITION BY x."SMILES"
    ORDER BY p.priority, x."pH", x."Buffer_%") AS rn
  FROM cx x JOIN c_qmap m ON x.run_id = m.run_id JOIN c_said s ON s.qid = m.qid JOIN prio p ON p.code = s.prediction),
best AS (SELECT * FROM ranked WHERE rn = 1),
{knn('rtrain', 'best', '"Retention_Time_min"', 5, 'r_')}, {regress('r_')}
SELECT b."SMILES", b."pH" AS ph, b."Buffer_%" AS org, b."Organic_%" AS buf, b.label, {r6('s.prediction')} AS retention
FROM best b JOIN r_qmap m ON b.run_id = m.run_id JOIN r_said s ON s.qid = m.qid"""
    det = "(suu * svv - suv * suv)"
    z = {"uu": "n", "vv": "n", "uv": "suv * n / sqrt(suu * svv)", "uy": "suy / sqrt(suu / n)", "vy": "svy / sqrt(svv / n)"}
    rdet = f"(({z['uu']} + 1.0) * ({z['vv']} + 1.0) - ({z['uv']}) * ({z['uv']}))"
    ru = f"((({z['vv']} + 1.0) * ({z['uy']}) - ({z['uv']}) * ({z['vy']})) / {rdet} / sqrt(suu / n))"
    rv = f"((({z['uu']} + 1.0) * ({z['vy']}) - ({z['uv']}) * ({z['uy']})) / {rdet} / sqrt(svv / n))"
    bu, bv = f"((svv * suy - suv * svy) / {det})", f"((suu * svy - suv * suy) / {det})"
    out = {
        "ingest_runs": f"WITH {RUNS} SELECT * FROM runs",
        "csv_roundtrip": f"""WITH {RUNS} SELECT run_id, "Compound", "SMILES", "Retention_Time_min", "Separation_Quality",
          "Buffer_%", "Organic_%", nullif("pH", 'n/a') AS "pH" FROM runs""",
        "ph_coerce": f'WITH {RUNS} SELECT run_id, TRY_CAST("pH" AS DOUBLE) AS "pH" FROM runs',
        "label_fill": f"""WITH {RUNS} SELECT run_id, coalesce("Separation_Quality", 'No data') AS "Separation_Quality" FROM runs""",
        "label_encode": f'WITH {DS} SELECT run_id, "Separation_Quality", code AS "SepQuality_Code" FROM ds',
        "label_decode": f'WITH {DS} SELECT run_id, "Separation_Quality" AS label FROM ds',
        "label_dictionary": f"WITH {DS} SELECT code, label FROM labels",
        "feature_table": f'WITH {DS} SELECT run_id, {feats}, "Retention_Time_min", code AS "SepQuality_Code" FROM ds',
        "known_target": f'WITH {DS} SELECT run_id, "Retention_Time_min" FROM ds WHERE "Retention_Time_min" IS NOT NULL',
        "preview": f"WITH {DS} SELECT run_id, {pv} FROM (SELECT * FROM ds ORDER BY run_id LIMIT 1000)",
        "run_label": f"""WITH {DS} SELECT run_id, "Compound" || ' ' || CAST(CAST("Buffer_%" AS BIGINT) AS VARCHAR) || ':' ||
          CAST(CAST("Organic_%" AS BIGINT) AS VARCHAR) || ' ' || CAST("pH" AS VARCHAR) AS run_label FROM ds""",
        "dataset_summary": f"""WITH {DS} SELECT count(*) AS n_rows, 14 AS n_cols,
          'run_id,Compound,SMILES,Retention_Time_min,Separation_Quality,Buffer_%,Organic_%,pH,MolWt,LogP,TPSA,HBD,HBA,SepQuality_Code' AS columns FROM ds""",
        "descriptor_enrich": f'WITH {DS} SELECT run_id, "SMILES", {desc} FROM ds',
        "descriptor_strict": f"""WITH {RUNS}, {DESCRIPTORS} SELECT r.run_id, d.* FROM runs r JOIN descriptors d ON r."SMILES" = d."SMILES" """,
        "descriptor_rejects": f"""WITH {RUNS}, {DESCRIPTORS} SELECT run_id, "SMILES" FROM runs r
          WHERE NOT EXISTS (SELECT 1 FROM descriptors d WHERE r."SMILES" = d."SMILES")""",
        "default_condition": f"""WITH {RUNS}, {DESCRIPTORS}, {COMPOUNDS} SELECT "SMILES", {desc}, "Buffer_%", "Organic_%", "pH" FROM compq""",
        "split_random": f"WITH {RUNS} SELECT run_id, {h(42)} % 100 < 20 AS is_test FROM runs",
        "split_exact": f"WITH {DS}, {REG_SPLIT} SELECT run_id, is_test FROM rsplit",
        "split_stratified": f"WITH {DS}, {CLF_SPLIT} SELECT run_id, code, is_test FROM csplit",
        "folds": f"WITH {RUNS} SELECT run_id, {h(43)} % 3 AS fold FROM runs",
        "folds_stratified": f"""WITH {DS} SELECT run_id, code,
          (row_number() OVER (PARTITION BY code ORDER BY {h(43)}, run_id) - 1) % 3 AS fold FROM ds""",
        "class_counts": f'WITH {DS} SELECT code AS "SepQuality_Code", count(*) AS n FROM ds GROUP BY code',
        "axis_values": f"""WITH {DS} SELECT DISTINCT 'pH' AS axis, "pH" AS value FROM ds WHERE "pH" IS NOT NULL UNION ALL
          SELECT DISTINCT 'Buffer_%', "Buffer_%" FROM ds UNION ALL SELECT DISTINCT 'Organic_%', "Organic_%" FROM ds""",
        "standardize": _standardize(),
        "gram": _gram(FEATS),
        "correlation": _corr([*FEATS, "Retention_Time_min"]),
        "knn_join": f"""WITH {DS}, {REG_SPLIT}, rtrain AS (SELECT * FROM rsplit WHERE NOT is_test),
          rtest AS (SELECT * FROM rsplit WHERE is_test), {knn('rtrain', 'rtest', '"Retention_Time_min"', 3, 'r_')}
          SELECT m.run_id, rk AS rank, member AS neighbour, {r6('sqrt(d2)')} AS distance FROM r_qmap m JOIN r_nn n ON m.qid = n.qid""",
        "knn_continuous": f"""WITH x AS (
            SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(min(l_extendedprice) AS DOUBLE) / 20000.0 AS a,
                   CAST(min(l_quantity) AS DOUBLE) / 10.0 AS b, CAST(min(l_discount) AS DOUBLE) * 20.0 AS c, CAST(min(l_tax) AS DOUBLE) * 20.0 AS d
            FROM lineitem GROUP BY l_orderkey, l_linenumber
          ), s AS (SELECT *, CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 5 AS asked FROM x
          ), n AS (
            SELECT q.id, min({{'d2': round((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c)
                                          + (q.d - t.d) * (q.d - t.d), 9), 't': t.id}}, 5) AS m
            FROM s q JOIN s t ON q.asked AND NOT t.asked GROUP BY q.id
          ), u AS (SELECT id, unnest(m) AS h FROM n)
          SELECT id AS run_id, row_number() OVER (PARTITION BY id ORDER BY h.d2, h.t) AS rank, h.t AS neighbour, {r6('h.d2')} AS d2 FROM u""",
        "csv_multiline": """SELECT CAST(s_suppkey AS BIGINT) AS run_id,
          s_name || chr(10) || '"line" two, ' || CAST(s_nationkey AS VARCHAR) AS "Compound" FROM supplier""",
        "knn_regress": f"WITH {REG_KNN} SELECT run_id, actual, {r6('prediction')} AS predicted FROM rscored",
        "knn_classify": f"WITH {CLF_KNN} SELECT run_id, actual, prediction AS predicted FROM cscored",
        "knn_grid_scores": knn_folds(),
        "reg_metrics": f"""WITH {REG_KNN} SELECT count(*) AS n, {r6(f'sqrt(avg({e} * {e}))')} AS rmse,
          {r6(f'1.0 - avg({e} * {e}) / var_pop(actual)')} AS r2, {r6(f'avg(abs({e}))')} AS mae FROM rscored""",
        "clf_metrics": f"""WITH {CLF_KNN} SELECT count(*) AS n,
          {r6('avg(CASE WHEN actual = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM cscored""",
        "confusion": f"""WITH {CLF_KNN} SELECT a.code AS actual, p.code AS predicted,
          count(s.run_id) AS n FROM labels a JOIN labels p ON true LEFT JOIN cscored s ON s.actual = a.code AND s.prediction = p.code
          GROUP BY a.code, p.code""",
        "class_report": f"""WITH {REPORT}
          SELECT label, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f')} AS f1, CAST(support AS BIGINT) AS support FROM prf
          UNION ALL SELECT 'macro avg', {r6('avg(p)')}, {r6('avg(r)')}, {r6('avg(f)')}, CAST(sum(support) AS BIGINT) FROM prf
          UNION ALL SELECT 'weighted avg', {r6('sum(p * support) / sum(support)')}, {r6('sum(r * support) / sum(support)')},
            {r6('sum(f * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM prf
          UNION ALL SELECT 'accuracy', {r6('sum(hit) / sum(support)')}, {r6('sum(hit) / sum(support)')},
            {r6('sum(hit) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM prf""",
        "roc_ovr": f"""WITH {CURVES} SELECT class, {r6('score')} AS threshold, {r6('cn / tn')} AS fpr, {r6('cp / tp')} AS tpr FROM cum
          UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM cum""",
        "auc_ovr": f"""WITH {CURVES} SELECT class, {r6('sum(neg * (cp - pos / 2.0)) / (any_value(tp) * any_value(tn))')} AS auc
          FROM cum GROUP BY class""",
        "pr_ovr": f"""WITH {CURVES} SELECT class, {r6('score')} AS threshold, {r6('cp / (cp + cn)')} AS precision,
          {r6('cp / tp')} AS recall FROM cum UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM cum""",
        "residuals": f"WITH {REG_KNN} SELECT run_id, {r6('prediction')} AS predicted, {r6(e)} AS residual FROM rscored",
        "identity_line": f"WITH {REG_KNN} SELECT min(actual) AS low, max(actual) AS high FROM rscored",
        "conditions": f"WITH {DS}, {CONDITIONS} SELECT * FROM conds",
        "condition_scores": f"WITH {CONDS_SCORED} SELECT ph, org, buf, code FROM scored",
        "best_condition": f"""WITH {CONDS_SCORED} SELECT ph, org, buf, label FROM scored JOIN prio USING (code)
          ORDER BY priority, ph, org LIMIT 1""",
        "top_conditions": f"""WITH {CONDS_SCORED} SELECT ph, org, buf, label FROM scored JOIN prio USING (code)
          ORDER BY priority, ph, org LIMIT 10""",
        "top_conditions_code": f"""WITH {CONDS_SCORED} SELECT ph, org, buf, label FROM scored JOIN prio USING (code)
          ORDER BY code DESC, ph, org LIMIT 10""",
        "heatmap": f"""WITH {CONDS_SCORED} SELECT a.ph, b.org, s.code FROM (SELECT DISTINCT "pH" AS ph FROM ds WHERE "pH" IS NOT NULL) a
          JOIN (SELECT DISTINCT "Buffer_%" AS org FROM ds WHERE "Buffer_%" IS NOT NULL) b ON true
          LEFT JOIN scored s ON s.ph = a.ph AND s.org = b.org""",
        "suggest_per_compound": f"SELECT x.*, {CLF_ACCURACY} AS accuracy, {REG_R2} AS r2 FROM ({suggest}) x",
        "predict_retention": f"""WITH {DS}, {REG_SPLIT}, {COMPOUNDS}, rtrain AS (SELECT * FROM rsplit WHERE NOT is_test),
          {knn('rtrain', 'compq', '"Retention_Time_min"', 5, 'r_')}, {regress('r_')}
          SELECT c."SMILES", {r6('s.prediction')} AS retention FROM compq c JOIN r_qmap m ON c.run_id = m.run_id JOIN r_said s ON s.qid = m.qid""",
        "predict_quality": f"""WITH {DS}, {CLF_SPLIT}, {COMPOUNDS}, ctrain AS (SELECT * FROM csplit WHERE NOT is_test),
          {knn('ctrain', 'compq', 'code', 5, 'c_')}, {classify('c_')}
          SELECT c."SMILES", s.prediction AS code, l.label, {CLF_ACCURACY} AS accuracy FROM compq c JOIN c_qmap m ON c.run_id = m.run_id
          JOIN c_said s ON s.qid = m.qid JOIN labels l ON l.code = s.prediction""",
        "qsrr_single": f"WITH {DS}, {SINGLE} SELECT {r6('b')} AS slope, {r6('a')} AS intercept, {r6('r2')} AS r2, n FROM fit",
        "qsrr_two": f"WITH {DS}, {TWO} SELECT {r6(bu)} AS logp, {r6(bv)} AS ph, {r6(f'my - {bu} * mu - {bv} * mv')} AS intercept FROM two",
        "ridge_two": f"WITH {DS}, {TWO} SELECT {r6(ru)} AS logp, {r6(rv)} AS ph, {r6(f'my - {ru} * mu - {rv} * mv')} AS intercept FROM two",
        "pca_total_variance": f"WITH {DS} SELECT {r6(' + '.join(f'var_samp({zero(f)})' for f in FEATS))} AS total FROM ds",
        "score_stream": f"""WITH {DS}, {SINGLE} SELECT run_id, {r6('a + b * CAST("MolWt" AS DOUBLE)')} AS prediction FROM ds, fit""",
        "stream_knn": f"""WITH {DS}, {REG_SPLIT}, rtrain AS (SELECT * FROM rsplit WHERE NOT is_test),
          {knn('rtrain', 'ds', '"Retention_Time_min"', 5, 'r_')}, {regress('r_')}
          SELECT m.run_id, {r6('s.prediction')} AS prediction FROM r_qmap m JOIN r_said s ON m.qid = s.qid""",
        "model_roundtrip": f"""WITH {DS}, {SINGLE} SELECT run_id, {r6('a + b * CAST("MolWt" AS DOUBLE)')} AS prediction FROM ds, fit""",
        "qsrr_points": f"""WITH {DS}, {SINGLE} SELECT run_id, "Retention_Time_min" AS actual,
          {r6('a + b * CAST("MolWt" AS DOUBLE)')} AS fitted FROM ds, fit WHERE "Retention_Time_min" IS NOT NULL""",
        "knn_graph": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
          rep AS (SELECT v, min(vec_id) AS id FROM e GROUP BY v),
          p AS (SELECT a.id AS i, b.id AS j, round(power(list_distance(a.v, b.v), 2), 9) AS d2
            FROM rep a, rep b WHERE a.id <> b.id),
          t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM p)
          SELECT i, j, rank, {r6('sqrt(d2)')} AS distance FROM t WHERE rank <= 14""",
    }
    reg = f"SELECT 'KNN' AS model, 'Regression' AS type, {r6(f'sqrt(avg({e} * {e}))')} AS rmse, {r6(f'1.0 - avg({e} * {e}) / var_pop(actual)')} AS r2, {r6(f'avg(abs({e}))')} AS mae, CAST(NULL AS DOUBLE) AS accuracy FROM rscored"
    body = CLF_KNN[len(DS):]
    out["results_table"] = f"""WITH {REG_KNN}{body} {reg} UNION ALL
      SELECT 'KNN', 'Classification', NULL, NULL, NULL, {r6('avg(CASE WHEN actual = prediction THEN 1.0 ELSE 0.0 END)')} FROM cscored"""
    from chromaspark.plans import proof_sql  # builds on the parts above

    return out | proof_sql.oracles()
