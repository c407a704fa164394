"""The queries once more as SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

from gridloom.plans.fixtures import ARMS, LABELS

_OBS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_IDX = f"""idx AS (SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, n_name AS dataset, r_name AS grp,
 n_name || '|' || o_custkey AS donor, o_orderpriority AS label FROM {_OBS})"""
_EXPR = "expr AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_NAMED = f"""{_EXPR}, cells AS (SELECT o_orderkey AS cell, n_name AS dataset FROM {_OBS}),
 named AS (SELECT expr.*, dataset, upper(p_name) LIKE 'HOT%' AS mito FROM expr JOIN part ON gene = p_partkey JOIN cells USING (cell))"""
_METRICS = f"""{_NAMED}, metrics AS (SELECT cell, count(*) FILTER (value > 0) AS n_genes, sum(value) AS total,
 coalesce(sum(value) FILTER (mito), 0) AS mito, CASE WHEN sum(value) > 0 THEN 100 * coalesce(sum(value) FILTER (mito), 0) / sum(value) ELSE 0 END AS pct_mito
 FROM named GROUP BY cell)"""
_RULES = """rules AS (SELECT * FROM (VALUES ('1-URGENT','acute','CL:1','map',''), ('2-HIGH','acute','CL:1','map',''), ('3-MEDIUM','steady','CL:2','map',''),
 ('5-LOW','steady','CL:3','map',''), ('4-NOT SPECIFIED',NULL,'','drop','unspecified')) t(label_raw, working_class, cl_term, action, reason))"""


def _latest(table: str, key: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) = 1)"


def _order(seed: int | str, key: str) -> str:
    return f"md5('{seed}|' || {key}), {key}"


def _s1(seed: int) -> str:
    return f"""(SELECT cell_id, dataset, label, CASE WHEN rn <= tr THEN 'train' WHEN rn <= tr + ca THEN 'calibration' ELSE 'test' END AS "partition" FROM (
 SELECT *, CASE WHEN n >= 3 THEN least(round_even(0.6 * n, 0), n - 2) ELSE n END AS tr, round_even(0.2 * n, 0) AS ca FROM (
 SELECT cell_id, dataset, label, row_number() OVER (PARTITION BY dataset, label ORDER BY {_order(seed, 'cell_id')}) AS rn,
 count(*) OVER (PARTITION BY dataset, label) AS n FROM idx)))"""


def _units(source: str, scope: str, unit: str, seed: int, train: float = 0.6, calibration: float = 0.2, two: bool = False) -> str:
    """Whole units: floors, one at least; with these fractions only the first part ever gives or takes."""
    last = "0" if two else f"greatest(floor({1 - train - calibration:.1f} * n), 1)"
    return f"""(SELECT {scope}{unit}, CASE WHEN rn <= n - ca - te THEN 'train' WHEN rn <= n - te THEN 'calibration' ELSE 'test' END AS "partition" FROM (
 SELECT *, greatest(floor({calibration!r} * n), 1) AS ca, {last} AS te FROM (SELECT *, row_number() OVER (PARTITION BY {scope or '1, '}1 ORDER BY {_order(seed, unit)}) AS rn,
 count(*) OVER (PARTITION BY {scope or '1, '}1) AS n FROM (SELECT DISTINCT {scope}{unit} FROM {source}))))"""


_S2 = lambda seed: f"(SELECT cell_id, \"partition\" FROM idx JOIN {_units('idx', 'dataset, ', 'donor', seed)} USING (dataset, donor))"
_S3 = f"(SELECT cell_id, \"partition\" FROM idx JOIN {_units('idx', '', 'grp', 0)} USING (grp))"
_S3H = f"""(SELECT cell_id, CASE WHEN grp = 'ASIA' THEN 'test' ELSE u."partition" END AS "partition" FROM idx LEFT JOIN
 {_units("(SELECT * FROM idx WHERE grp <> 'ASIA')", '', 'grp', 0, 0.6 / 0.8, 0.2 / 0.8, True)} u USING (grp))"""
_MANY = f"""{_IDX}, many AS (SELECT 'S1_within_dataset' AS scheme, 0 AS seed, '' AS holdout_group, cell_id, "partition" FROM {_s1(0)}
 UNION ALL SELECT 'S2_leave_donor_out', 0, '', * FROM {_S2(0)} UNION ALL SELECT 'S3_leave_dataset_out', 0, '', * FROM {_S3}
 UNION ALL SELECT 'S3_leave_dataset_out', 0, 'ASIA', * FROM {_S3H})"""
_DICT = "dict AS (SELECT p_partkey AS gene, p_partkey + 10 AS token, p_retailprice AS median FROM part WHERE p_partkey % 3 <> 0)"
_ENC = lambda n: f"""{_EXPR}, {_DICT}, enc AS (SELECT cell, list(token ORDER BY rn) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY
 round(value / total * 1e4 / median, 9) DESC, gene) AS rn FROM (SELECT *, sum(value) OVER (PARTITION BY cell) AS total FROM expr JOIN dict USING (gene) WHERE value > 0 AND median > 0))
 WHERE rn <= {n} GROUP BY cell)"""  # noqa: E731
_LABELS = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_ARMS = ", ".join(f"('{a}', {w})" for a, w in ARMS)
_HASH = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
_PRED = f"""{_IDX}, pred AS (SELECT representation, scheme, CASE WHEN scheme LIKE 'S3%' THEN grp ELSE '' END AS holdout_group, budget, seed, dataset, cell_id, label AS y_true,
 CASE WHEN {_HASH("representation || '|' || budget || '|' || seed || '|' || cell_id")} % 100 < wrong + CASE WHEN budget = '10' THEN 15 ELSE 0 END + CAST(regexp_extract(dataset, '(\\d+)$', 1) AS INT) % 7
 THEN {_LABELS}[CAST(substr(label, 1, 1) AS INT) % 5 + 1] ELSE label END AS y_pred
 FROM idx, (VALUES {_ARMS}) a(representation, wrong), (VALUES ('10'), ('all')) b(budget), (VALUES (0), (1)) s(seed), (VALUES ('S1_within_dataset'), ('S3_leave_dataset_out')) c(scheme)
 WHERE scheme LIKE 'S3%' OR {_HASH("'s1|' || seed || '|' || cell_id")} % 5 = 0)"""
_RUN = "representation, scheme, holdout_group, budget, seed"
_KNOWN = "(budget = 'all' OR {} <> '5-LOW')"


def _per_class(by: str, rows: str) -> str:
    return f"""(SELECT {by}, label, sum(h) AS tp, sum(t) AS n_true, sum(p) AS n_pred, 2.0 * sum(h) / (sum(t) + sum(p)) AS f1, CASE WHEN sum(t) > 0 THEN sum(h) / sum(t) ELSE 0 END AS recall FROM (
 SELECT {by}, y_true AS label, 1.0::DOUBLE AS t, 0.0::DOUBLE AS p, (y_true = y_pred)::INT::DOUBLE AS h FROM {rows} UNION ALL SELECT {by}, y_pred, 0.0, 1.0, 0.0 FROM {rows}) GROUP BY {by}, label)"""


def _whole(by: str) -> str:
    return f"""(SELECT {by}, count(*) AS n_test, count(DISTINCT y_true) FILTER ({_KNOWN.format('y_true')}) AS n_classes_learnable,
 count(DISTINCT y_true) FILTER (NOT {_KNOWN.format('y_true')}) AS n_classes_test_only, avg((y_true = y_pred)::INT) AS accuracy FROM pred GROUP BY {by})"""


_BY = f"{_RUN}, dataset"
_T2 = f"""{_PRED}, per AS {_per_class(_BY, 'pred')}, t2 AS (SELECT w.*, m.macro_f1, m.macro_f1_all_test_classes,
 scheme || '__seed' || seed || CASE WHEN holdout_group <> '' THEN '__holdout-' || holdout_group ELSE '' END || '.parquet' AS split_file FROM {_whole(_BY)} w
 JOIN (SELECT {_BY}, avg(f1) FILTER ({_KNOWN.format('label')}) AS macro_f1, avg(f1) AS macro_f1_all_test_classes FROM per WHERE n_true > 0 GROUP BY {_BY}) m USING ({_BY}))"""
_AGG = f"""{_T2}, agg AS (SELECT dataset, representation, scheme, budget, avg(macro_f1) AS macro_f1, stddev_samp(macro_f1) AS sd, count(macro_f1) AS n_runs FROM t2 GROUP BY ALL)"""
_PAIR = f"""{_AGG}, pair AS (SELECT a.scheme, a.budget, a.dataset, round(a.macro_f1 - b.macro_f1, 12) AS d FROM agg a JOIN agg b USING (scheme, budget, dataset)
 WHERE a.representation = 'rank' AND b.representation = 'pca')"""
_OVERLAP = f"""{_NAMED}, sets AS (SELECT DISTINCT dataset, gene FROM named), overlap AS (SELECT x.dataset AS a, y.dataset AS b,
 count(z.gene) / greatest(count(*), 1) AS overlap FROM sets x CROSS JOIN (SELECT DISTINCT dataset FROM sets) y LEFT JOIN sets z ON z.dataset = y.dataset AND z.gene = x.gene GROUP BY ALL)"""
_FAMILY = f"""{_T2}, fam AS (SELECT dataset, representation, CASE WHEN dataset <> 'NATION_7' THEN round(pow(1 - acc, 4), 9) END AS p_raw, acc - 0.7 AS delta FROM (
 SELECT dataset, representation, round(avg(accuracy), 9) AS acc FROM t2 GROUP BY ALL)), ranked AS (SELECT *, row_number() OVER (ORDER BY p_raw NULLS LAST, dataset, representation) AS rk,
 count(p_raw) OVER () AS m FROM fam), bh AS (SELECT a.dataset, a.representation, a.p_raw, a.delta, CASE WHEN a.p_raw IS NOT NULL THEN least(min(b.p_raw * b.m / b.rk), 1) END AS p_fdr
 FROM ranked a JOIN ranked b ON b.rk >= a.rk GROUP BY a.dataset, a.representation, a.p_raw, a.delta)"""
_NORMB = """CASE WHEN budget IS NULL OR lower(trim(budget)) IN ('', 'nan', 'none', 'all') THEN 'all' WHEN try_cast(trim(budget) AS DOUBLE) = floor(try_cast(trim(budget) AS DOUBLE))
 THEN CAST(CAST(try_cast(trim(budget) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(budget) END"""
_DONE = f"done AS (SELECT result_id, representation, split_file, {_NORMB} AS budget, seed, n_test, macro_f1 FROM {_latest('pilot_results_long', 'result_id')})"
_R6 = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_VEC = "vec AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS cell_id, CAST(label AS VARCHAR) AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings)"
_BOOT = f"""(SELECT scheme, budget, n, b, avg(v[i + 1]) AS m FROM (SELECT scheme, budget, n, v, b, {_HASH("b || '|' || j || '|0'")} % n AS i FROM (
 SELECT scheme, budget, count(*) AS n, list(d ORDER BY dataset) AS v FROM pair GROUP BY ALL), range(1, 1001) bb(b), range(1, 1000) jj(j) WHERE j <= n) GROUP BY ALL)"""

SQL: dict[str, str] = {
    "cell_index": f'WITH {_IDX} SELECT cell_id, dataset, grp AS "group", donor, label FROM idx',
    "manifest_cells": f"SELECT dataset, label, count(*) AS n_cells, count(DISTINCT donor) AS n_donors FROM {_latest('cell_index', 'cell_id')} WHERE label IS NOT NULL GROUP BY ALL",
    "matrix_dims": "SELECT count(DISTINCT l_orderkey) AS n_cells, count(DISTINCT l_partkey) AS n_genes FROM lineitem",
    "counts_of_cells": f"WITH {_EXPR} SELECT expr.* FROM expr JOIN orders ON cell = o_orderkey WHERE o_orderpriority = '1-URGENT'",
    "row_block": f"WITH {_EXPR} SELECT * FROM expr WHERE cell BETWEEN 1000 AND 1999",
    "unique_gene_names": """SELECT gene, CASE WHEN nth > 0 THEN name || '-' || nth ELSE name END AS name FROM (
 SELECT p_partkey AS gene, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS nth FROM part)""",
    "union_of_parts": """SELECT c_nationkey AS nation, count(*) AS n, 'customer' AS source FROM customer GROUP BY 1
 UNION ALL SELECT s_nationkey, count(*), 'supplier' FROM supplier GROUP BY 1""",
    "duplicate_keys": "SELECT row_id, count(*) AS n FROM t4_label_harmonisation GROUP BY 1 HAVING count(*) > 1",
    "label_harmonise": f"WITH {_IDX}, {_RULES} SELECT cell_id, label AS label_raw, working_class, cl_term, action, reason FROM idx LEFT JOIN rules ON label = label_raw",
    "label_accounting": f"""WITH {_IDX}, {_RULES} SELECT dataset, label_raw, working_class, action, count(*) AS n_cells FROM idx LEFT JOIN rules ON label = label_raw GROUP BY ALL""",
    "label_rules": f"WITH {_RULES} SELECT label_raw, cl_term, coalesce(working_class, '') AS working_class, action, reason FROM rules",
    "unmapped_labels": "SELECT '5-LOW' AS label_raw FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1",
    "qc_cell_metrics": f"WITH {_METRICS} SELECT cell, n_genes, {_R6('total', 'mito', 'pct_mito')} FROM metrics",
    "qc_filter_stats": f"""WITH {_METRICS}, every AS (SELECT dataset, coalesce(n_genes, 0) AS n_genes, coalesce(pct_mito, 0) AS pct_mito FROM cells LEFT JOIN metrics USING (cell))
 SELECT dataset, count(*) AS cells_before, count(*) FILTER (n_genes < 2) AS failed_min_genes, count(*) FILTER (pct_mito > 20) AS failed_max_pct_mito,
 round(median(n_genes), 6) AS median_genes_per_cell, round(median(pct_mito), 6) AS median_pct_mito, count(*) FILTER (n_genes >= 2 AND pct_mito <= 20) AS cells_after FROM every GROUP BY 1""",
    "gene_filter": f"""WITH {_METRICS} SELECT gene, count(*) FILTER (value > 0) AS n_cells FROM expr JOIN metrics USING (cell) WHERE n_genes >= 2 AND pct_mito <= 20
 GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 3""",
    "mito_filter_applied": f"WITH {_NAMED} SELECT dataset, bool_or(mito) AS mito_filter_applied, count(DISTINCT gene) FILTER (mito) AS mito_genes_found FROM named GROUP BY 1",
    "gene_intersection": f"SELECT l_partkey AS gene FROM lineitem JOIN {_OBS.replace(' JOIN', ' ON l_orderkey = o_orderkey JOIN', 1)} GROUP BY 1 HAVING count(DISTINCT r_name) = 5",
    "gene_overlap_matrix": f"WITH {_OVERLAP} SELECT a, b, {_R6('overlap')} FROM overlap",
    "water_fill_cap": f"""WITH {_IDX}, n AS (SELECT dataset, label, count(*) AS n FROM idx GROUP BY ALL), tot AS (SELECT dataset, sum(n) AS total, max(n) AS top FROM n GROUP BY 1),
 tried AS (SELECT dataset, cap, sum(least(n, cap)) AS got FROM n JOIN (SELECT dataset, total, unnest(range(1, top + 1)) AS cap FROM tot) USING (dataset) WHERE total > 300 GROUP BY ALL)
 SELECT dataset, CAST(min(cap) AS BIGINT) AS cap FROM tot LEFT JOIN (SELECT dataset, cap FROM tried WHERE got >= 300) USING (dataset) GROUP BY 1""",
    "stratified_cap": f"""WITH {_IDX}, n AS (SELECT dataset, label, count(*) AS n FROM idx GROUP BY ALL), tot AS (SELECT dataset, sum(n) AS total, max(n) AS top FROM n GROUP BY 1),
 tried AS (SELECT dataset, cap, sum(least(n, cap)) AS got FROM n JOIN (SELECT dataset, unnest(range(1, top + 1)) AS cap FROM tot WHERE total > 300) USING (dataset) GROUP BY ALL),
 cap AS (SELECT dataset, min(cap) AS cap FROM tried WHERE got >= 300 GROUP BY 1) SELECT cell_id, dataset, label FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY
 {_order(0, 'cell_id')}) AS rn FROM idx) LEFT JOIN cap USING (dataset) WHERE cap IS NULL OR rn <= cap""",
    "split_s1": f"""WITH {_IDX} SELECT dataset, "partition", count(*) AS n_cells, count(DISTINCT label) AS n_classes FROM {_s1(0)} GROUP BY ALL""",
    "split_s1_cells": f'WITH {_IDX} SELECT cell_id, "partition" FROM {_s1(1)}',
    "split_s2": f"WITH {_IDX} SELECT * FROM {_S2(0)}",
    "split_s3_free": f"WITH {_IDX} SELECT * FROM {_S3}",
    "split_s3_holdout": f"WITH {_IDX} SELECT * FROM {_S3H}",
    "unit_allocation": f"WITH {_IDX} SELECT * FROM {_units('idx', 'dataset, ', 'donor', 3)}",
    "split_manifest": f"""WITH {_MANY}, j AS (SELECT many.*, dataset, label FROM many JOIN idx USING (cell_id)),
 sets AS (SELECT scheme, seed, holdout_group, list(DISTINCT label) FILTER ("partition" = 'train') AS tr, list(DISTINCT label) FILTER ("partition" = 'test') AS te FROM j GROUP BY ALL)
 SELECT scheme, seed, holdout_group, {', '.join(f'''count(*) FILTER ("partition" = '{p}') AS n_{p}, count(DISTINCT label) FILTER ("partition" = '{p}') AS classes_{p},
 count(DISTINCT dataset) FILTER ("partition" = '{p}') AS datasets_{p}''' for p in ('train', 'calibration', 'test'))},
 any_value(len(list_intersect(tr, te))) AS classes_learnable, any_value(len(list_filter(te, lambda x: NOT list_contains(tr, x)))) AS classes_test_only
 FROM j JOIN sets USING (scheme, seed, holdout_group) GROUP BY ALL""",
    "leakage_audit": f"""WITH {_MANY}, audited AS (SELECT * FROM many UNION ALL SELECT 'S3_leave_dataset_out', 9, '', cell_id, "partition" FROM {_s1(0)}),
 j AS (SELECT audited.*, donor, grp FROM audited JOIN idx USING (cell_id)),
 d AS (SELECT scheme, seed, holdout_group, count(*) AS n FROM (SELECT scheme, seed, holdout_group, donor FROM j WHERE scheme NOT LIKE 'S1%' GROUP BY ALL HAVING count(DISTINCT "partition") > 1) GROUP BY ALL),
 g AS (SELECT scheme, seed, holdout_group, count(*) AS n FROM (SELECT scheme, seed, holdout_group, grp FROM j WHERE scheme LIKE 'S3%' GROUP BY ALL HAVING count(DISTINCT "partition") > 1) GROUP BY ALL)
 SELECT p.*, coalesce(d.n, 0) AS donors_spanning, coalesce(g.n, 0) AS groups_spanning FROM (SELECT scheme, seed, holdout_group, CAST(0 AS BIGINT) AS cells_unassigned,
 3 - count(DISTINCT "partition") AS partitions_empty FROM j GROUP BY ALL) p LEFT JOIN d USING (scheme, seed, holdout_group) LEFT JOIN g USING (scheme, seed, holdout_group)""",
    "split_alignment": f"WITH {_IDX} SELECT cell_id, 'index' AS side FROM idx WHERE dataset = 'NATION_3'",
    "partition_read": f"WITH {_IDX} SELECT * FROM {_S2(0)} WHERE \"partition\" <> 'calibration'",
    "classes_learnable": f"""WITH {_IDX} SELECT label, CASE WHEN label = '5-LOW' THEN 'test_only' ELSE 'learnable' END AS kind FROM (SELECT DISTINCT label FROM idx)""",
    "split_names": f"""SELECT file, regexp_extract(file, '^(.*?)__', 1) AS scheme, CAST(regexp_extract(file, '__seed(\\d+)', 1) AS INT) AS seed,
 CASE WHEN contains(file, '__holdout-') THEN regexp_extract(file, '__holdout-(.*)\\.parquet$', 1) ELSE '' END AS holdout_group FROM (
 SELECT DISTINCT file FROM split_manifest) QUALIFY (row_number() OVER (ORDER BY file) - 1) % 3 = 1""",
    "first_splits": """SELECT scheme, file AS split_file FROM (SELECT DISTINCT scheme, file FROM split_manifest) QUALIFY row_number() OVER (PARTITION BY scheme ORDER BY file) <= 5""",
    "log_norm": f"WITH {_EXPR} SELECT cell, gene, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell)), 6) AS value FROM expr",
    "pseudo_counts": f"WITH {_EXPR} SELECT cell, gene, round_even(exp(round(ln(1 + value), 9)) - 1, 0) AS value FROM expr WHERE value <> 0",
    "gene_moments": f"""WITH {_EXPR}, n AS (SELECT count(*) AS n FROM orders), s AS (SELECT gene, sum(value) / n AS mean, sum(value * value) / n AS sq, n FROM expr, n GROUP BY gene, n),
 v AS (SELECT gene, mean, greatest(sq - mean * mean, 0) * n / (n - 1) AS variance FROM s) SELECT gene, {_R6('mean', 'variance')}, round(CASE WHEN mean > 0 THEN variance / mean ELSE 0 END, 6) AS dispersion FROM v""",
    "hvg_select": f"""WITH {_EXPR}, n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0), s AS (SELECT gene, sum(value) / n AS mean, sum(value * value) / n AS sq, n FROM expr, n WHERE cell % 5 <> 0 GROUP BY gene, n),
 v AS (SELECT gene, mean, greatest(sq - mean * mean, 0) * n / (n - 1) / mean AS disp FROM s WHERE mean > 0), e AS (SELECT quantile_cont(mean, [i / 20 FOR i IN range(21)]) AS edges FROM v),
 b AS (SELECT gene, disp, greatest(least(len(list_filter(edges, lambda t: round(t, 12) <= round(mean, 12))) - 1, 19), 0) AS bin FROM v, e), z AS (SELECT gene, round(CASE WHEN stddev_pop(disp) OVER w > 0 THEN
 (disp - avg(disp) OVER w) / stddev_pop(disp) OVER w ELSE 0 END, 9) AS score FROM b WINDOW w AS (PARTITION BY bin)) SELECT gene FROM z ORDER BY score DESC, gene LIMIT 200""",
    "rank_encode": f"WITH {_ENC(4)} SELECT cell, tokens FROM enc",
    "encoding_faults": "SELECT CAST(NULL AS BIGINT) AS cell, CAST(NULL AS VARCHAR) AS fault WHERE false",
    "vocab_coverage": "SELECT count(*) AS n_input, count(*) FILTER (p_partkey % 3 <> 0 AND p_retailprice > 0) AS n_mapped, round(avg((p_partkey % 3 <> 0 AND p_retailprice > 0)::INT), 6) AS frac_mapped FROM part",
    "standardise": f"""WITH {_VEC}, fit AS (SELECT place, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS sd FROM vec WHERE vec_id % 5 <> 0 GROUP BY 1)
 SELECT cell_id, CAST(place AS INT) AS place, round((x - mean) / sd, 6) AS z FROM vec JOIN fit USING (place)""",
    "pc_prefix": f"WITH {_VEC} SELECT cell_id, CAST(place AS INT) AS place, x FROM vec WHERE place < 30",
    "l2_normalise": f"WITH {_VEC} SELECT cell_id, CAST(place AS INT) AS place, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY cell_id)) AS n FROM vec)",
    "masked_mean_pool": f"WITH {_VEC} SELECT label, CAST(place AS INT) AS place, round(avg(x), 6) AS value FROM vec WHERE vec_id % 3 <> 0 GROUP BY ALL",
    "finite_vectors": "SELECT DISTINCT cell_id FROM cell_repr WHERE emb IS NULL OR len(list_filter(emb, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0",
    "representation_scan": "SELECT CAST(vec_id AS VARCHAR) AS cell_id, CAST(len(embedding) AS INT) AS width FROM embeddings WHERE vec_id % 2 = 0",
    "label_budget": f"WITH {_IDX} SELECT cell_id, label FROM idx QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_order(0, 'cell_id')}) <= 25",
    "cv_subsample": f"""WITH {_IDX}, n AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM idx GROUP BY 1) SELECT cell_id, label FROM (
 SELECT cell_id, label, row_number() OVER (PARTITION BY label ORDER BY {_order(0, 'cell_id')}) AS rn FROM idx) JOIN n USING (label)
 WHERE rn <= CASE WHEN total > 1000 THEN greatest(round_even(1000.0 * n / total, 0), least(n, 2)) ELSE n END""",
    "cv_folds": f"""WITH {_IDX}, k AS (SELECT least(min(n), 5) AS k FROM (SELECT count(*) AS n FROM idx GROUP BY label))
 SELECT cell_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_order(0, 'cell_id')}) - 1) % k AS INT) AS fold FROM idx, k""",
    "class_weights": f"WITH {_IDX} SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM idx GROUP BY 1",
    "rarity_strata": """WITH n AS (SELECT p_brand || '/' || p_type AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), f AS (SELECT *, n / sum(n) OVER () AS f FROM n)
 SELECT label, n, round(f, 6) AS prevalence, CASE WHEN f < 0.01 THEN 'rare' WHEN f < 0.05 THEN 'uncommon' ELSE 'common' END AS stratum FROM f""",
    "confusion": f"WITH {_PRED} SELECT {_RUN}, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL",
    "eval_pooled": f"""WITH {_PRED}, kept AS (SELECT * FROM pred WHERE {_KNOWN.format('y_true')}), inner_ AS {_per_class(_RUN, 'kept')}, every AS {_per_class(_RUN, 'pred')}
 SELECT {_RUN}, n_test, n_classes_learnable, n_classes_test_only, classes_learnable, {_R6('macro_f1', 'balanced_acc', 'macro_f1_all_test_classes', 'accuracy')} FROM {_whole(_RUN)}
 JOIN (SELECT {_RUN}, avg(f1) AS macro_f1, avg(recall) AS balanced_acc, string_agg(label, ';' ORDER BY label) AS classes_learnable FROM inner_ WHERE n_true > 0 GROUP BY {_RUN}) USING ({_RUN})
 JOIN (SELECT {_RUN}, avg(f1) AS macro_f1_all_test_classes FROM every WHERE n_true > 0 GROUP BY {_RUN}) USING ({_RUN})""",
    "eval_per_dataset": f"WITH {_T2} SELECT {_BY}, n_test, n_classes_learnable, n_classes_test_only, {_R6('macro_f1', 'macro_f1_all_test_classes', 'accuracy')} FROM t2",
    "per_class_f1": f"""WITH {_PRED}, per AS {_per_class(_BY, 'pred')} SELECT {_BY}, label AS cell_type, {_R6('f1')}, CAST(n_true AS BIGINT) AS n_test_cells_class,
 round(n_true / total, 6) AS class_prevalence, CAST(total AS BIGINT) AS n_test_cells_dataset FROM (SELECT *, sum(n_true) OVER (PARTITION BY {_BY}) AS total FROM per) WHERE n_true > 0 AND {_KNOWN.format('label')}""",
    "seed_aggregate": f"WITH {_AGG} SELECT dataset, representation, scheme, budget, {_R6('macro_f1')}, round(sd, 6) AS macro_f1_resample_sd, n_runs FROM agg",
    "run_range": f"""WITH {_AGG} SELECT scheme, budget, representation, CASE WHEN min(n_runs) = max(n_runs) THEN CAST(min(n_runs) AS VARCHAR) ELSE min(n_runs) || '-' || max(n_runs) END AS n_runs FROM agg GROUP BY ALL""",
    "paired_contrast": f"""WITH {_PAIR} SELECT scheme, budget, count(*) AS n_datasets, round(avg(d), 6) AS delta_mean, round(median(d), 6) AS delta_median,
 round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) END, 6) AS cohens_dz, count(*) FILTER (d > 0) AS n_datasets_favouring_a, string_agg(dataset, ';' ORDER BY dataset) AS datasets
 FROM pair GROUP BY ALL HAVING count(*) >= 3""",
    "bootstrap_ci": f"WITH {_PAIR} SELECT scheme, budget, n, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM {_BOOT} GROUP BY ALL",
    "wilcoxon_stat": f"""WITH {_PAIR}, r AS (SELECT scheme, budget, d, rank() OVER (PARTITION BY scheme, budget ORDER BY abs(d)) + (count(*) OVER (PARTITION BY scheme, budget, abs(d)) - 1) / 2.0::DOUBLE AS rk
 FROM pair WHERE d <> 0), s AS (SELECT scheme, budget, count(*) AS n_nonzero, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus FROM r GROUP BY ALL)
 SELECT *, least(w_plus, w_minus) AS wilcoxon_stat FROM s""",
    "ttest_stat": f"WITH {_PAIR} SELECT scheme, budget, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t_stat FROM pair GROUP BY ALL HAVING count(*) >= 3",
    "bh_fdr": f"WITH {_FAMILY} SELECT dataset, representation, {_R6('p_raw', 'p_fdr')} FROM bh",
    "verdict": f"""WITH {_FAMILY} SELECT dataset, representation, CASE WHEN p_fdr IS NULL OR p_fdr >= 0.01 THEN 'no detectable difference' WHEN abs(delta) < 0.02 THEN 'detectable but negligible (|delta| < 0.02)'
 WHEN delta > 0 THEN 'a better' ELSE 'b better' END AS verdict FROM bh""",
    "overlap_correlation": f"""WITH {_PAIR}, {_OVERLAP}, o AS (SELECT a AS dataset, round(avg(overlap), 9) AS overlap FROM overlap WHERE a <> b GROUP BY 1),
 j AS (SELECT dataset, overlap, round(d, 9) AS d FROM pair JOIN o USING (dataset) WHERE scheme LIKE 'S3%' AND budget = 'all'), r AS (SELECT *, rank() OVER (ORDER BY overlap) +
 (count(*) OVER (PARTITION BY overlap) - 1) / 2.0 AS rx, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS ry FROM j)
 SELECT count(*) AS n, round(corr(overlap, d), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(first(d ORDER BY overlap, dataset), 6) AS y_at_min_x,
 round(first(d ORDER BY overlap DESC, dataset DESC), 6) AS y_at_max_x FROM r""",
    "f1_budget_table": f"""WITH {_T2} SELECT scheme, representation, budget, round(avg(m), 6) AS mean, count(*) AS n_units FROM (SELECT scheme, representation, budget,
 CASE WHEN holdout_group <> '' THEN holdout_group ELSE split_file END AS unit, avg(macro_f1) AS m FROM t2 GROUP BY ALL) GROUP BY ALL""",
    "transfer_matrix": f"""WITH {_T2} SELECT holdout_group, {', '.join(f"round(avg(macro_f1) FILTER (representation = '{a}'), 6) AS {a}" for a, _ in ARMS)} FROM t2 WHERE holdout_group <> '' GROUP BY 1""",
    "budget_text": f"SELECT budget, {_NORMB} AS budget_text, count(*) AS n FROM pilot_results_long GROUP BY budget",
    "seed_grid": """SELECT r AS representation, file AS split_file, scheme, b AS budget, CAST(s AS INT) AS seed FROM (SELECT DISTINCT scheme, file FROM split_manifest), (VALUES ('rank'), ('pca')) a(r),
 (VALUES ('10'), ('100'), ('all')) c(b), range(5) e(s) WHERE s < CASE WHEN b = 'all' THEN 2 WHEN b = '10' AND scheme = 'S3_leave_group_out' THEN 5 ELSE 3 END""",
    "resume_anti_join": f"WITH {_DONE} SELECT representation, split_file, budget, seed FROM done GROUP BY ALL HAVING count(DISTINCT result_id) < 2",
    "shard_merge": f"""WITH {_DONE}, a AS (SELECT * FROM done WHERE result_id % 3 <> 0 UNION SELECT * FROM done WHERE result_id % 3 <> 1), ok AS (
 SELECT representation, split_file, budget, seed FROM a GROUP BY ALL HAVING count(DISTINCT result_id) >= 2)
 SELECT representation, split_file, budget, seed, CAST(result_id AS VARCHAR) AS dataset, n_test, round(macro_f1, 6) AS macro_f1 FROM a JOIN ok USING (representation, split_file, budget, seed)""",
    "run_settings": f"""SELECT representation, split_file, budget, seed, min(c_selected) AS C_selected, 30 AS n_dims_selected FROM {_latest('pilot_results_long', 'result_id')} GROUP BY ALL""",
    "recon_check": f"""WITH {_T2} SELECT CASE dataset WHEN 'NATION_4' THEN 'failed' WHEN 'NATION_5' THEN 'unrecorded' ELSE 'ok' END AS status, count(*) AS n FROM t2 WHERE scheme LIKE 'S1%' GROUP BY 1""",
    "topn_per_group": f"""SELECT cancer, dataset FROM {_latest('t1_dataset_manifest', 'dataset')} WHERE n_donors >= 3 AND n_mappable_immune_classes >= 3 AND mappable_immune_cells >= 500
 QUALIFY row_number() OVER (PARTITION BY cancer ORDER BY n_mappable_immune_classes DESC, cells_raw DESC NULLS LAST, dataset) <= 2""",
    "dataset_table": f"""WITH m AS (SELECT dataset, nullif(regexp_extract(lower(doi), '(10\\.\\d+/[a-z0-9.]*[a-z0-9])', 1), '') AS doi, cells_raw FROM {_latest('t1_dataset_manifest', 'dataset')}),
 l AS (SELECT dataset, count(*) AS n_labels, CAST(sum(n_cells) AS BIGINT) AS n_cells FROM {_latest('t4_label_harmonisation', 'row_id')} GROUP BY 1), s AS (SELECT doi, count(*) AS n_same_doi FROM m WHERE doi IS NOT NULL GROUP BY 1)
 SELECT dataset, doi, cells_raw, n_labels, n_cells, n_same_doi FROM m LEFT JOIN l USING (dataset) LEFT JOIN s USING (doi)""",
}
