"""Queries over the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import components, leakage, mapping, neighbours, packing, repetition, targets
from gridloom.sources.session import cut
from gridloom.sources.tables import latest, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that each typed label means, 0 for none."""
    fields = ["label_raw", "working_class", "cl_term"]
    rows = latest(table(spark, sf_dir, "t4_label_harmonisation"), ["row_id"], "loaded_at", fields)
    return mapping.mapped(rows, table(spark, sf_dir, "class_reference"), "row_id", fields)


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values that mean no class, with the nearest one and how near it is."""
    rows = latest(table(spark, sf_dir, "t4_label_harmonisation"), ["row_id"], "loaded_at", ["label_raw"])
    return mapping.values_of(rows.select(F.col("label_raw").alias("value")), table(spark, sf_dir, "class_reference")).filter("class_id = 0")


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.ties(table(spark, sf_dir, "t1_dataset_manifest"), table(spark, sf_dir, "split_manifest"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset tied to another, with the smallest dataset of its component."""
    return components.components(_ties(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "t1_dataset_manifest"), ["dataset"], "loaded_at", ["n_donors", "recorded_at", "ldo_group", "doi"])


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset with its component and partition, dealt out at once."""
    return components.dealt(_records(spark, sf_dir), _ties(spark, sf_dir))


def p3_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component table built in two steps: the datasets recorded by mid-2025, then all of them over that table."""
    rows = _records(spark, sf_dir)
    early = rows.filter("recorded_at < TIMESTAMP'2025-07-01'")
    first = cut(components.dealt(early, components.ties(early, table(spark, sf_dir, "split_manifest"))))
    return components.dealt(rows, _ties(spark, sf_dir), before=first)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets and share of the donors of each partition."""
    sums = p3_splits(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("n_datasets"), F.sum("weight").alias("donors"))
    return sums.withColumn("share", F.round(F.col("donors") / F.sum("donors").over(Window.partitionBy()), 4))


def _stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, dataset, class_id, cells) of the delivered label rows, class 0 where no class is meant."""
    cols = ["dataset", "working_class", "n_cells"]
    rows = latest(table(spark, sf_dir, "t4_label_harmonisation"), ["row_id"], "loaded_at", cols)
    meant = mapping.classed(rows, table(spark, sf_dir, "class_reference"), "working_class", "row_id")
    return cut(meant.select("row_id", "dataset", F.coalesce("class_id", F.lit(0)).alias("class_id"), F.coalesce("n_cells", F.lit(0)).alias("cells")))


def _calibrated(spark: SparkSession, sf_dir: str, stock: DataFrame) -> DataFrame:
    runs = table(spark, sf_dir, "pilot_results_long")
    budgets = runs.select(targets.whole_budget(F.col("budget")).alias("budget")).filter("budget IS NOT NULL").distinct()
    return targets.calibrated(stock, budgets, table(spark, sf_dir, "sample_target"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets, budgets and classes for which there are too few cells: the gaps of the calibration's report."""
    return _calibrated(spark, sf_dir, _stock(spark, sf_dir)).filter("available < asked").select("dataset", "budget", "class_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each dataset, budget and class asks, has and gives, with the class's share of the sample."""
    return _calibrated(spark, sf_dir, _stock(spark, sf_dir))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of each label row the sample of each budget takes."""
    stock = _stock(spark, sf_dir)
    return targets.drawn(stock, _calibrated(spark, sf_dir, stock))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cells that are among each other's five most similar, by a cosine of 0.93 or more."""
    return neighbours.mutual(table(spark, sf_dir, "cell_repr"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that alone exceed a training sequence."""
    return packing.cut_texts(packing.pack(table(spark, sf_dir, "documents")))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text with the training sequence it is in."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that carry a passage of an evaluation item, with the item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which at least 45 % repeat what they already said."""
    return repetition.repetitive(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its repeated share, ratios and flags."""
    out = repetition.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return out.withColumns(
        {c: F.round(c, 6) for c in ("distinct_ratio", "symbol_ratio", "stop_ratio", "line_repeat_ratio", "repeated_share")}
    )


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_report": p3_report,
    "p3_grown": p3_grown,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_sample": p4_sample,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_windows": p6_windows,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(repetition.STOP_WORDS)))
_MEASURED = rf"""w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
 g AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
 r AS (SELECT rid, i FROM g QUALIFY row_number() OVER (PARTITION BY rid, k ORDER BY i) > 1), c AS (SELECT rid, count(DISTINCT i + j) AS covered FROM r, range(8) x(j) GROUP BY 1),
 m AS (SELECT doc_id, len(ws) AS n_words, CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 1 END AS distinct_ratio,
 CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{N}}\s]', '', 'g'))) / length(t) ELSE 0 END AS symbol_ratio,
 CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: x IN ({_STOP}))) / len(ws) ELSE 0 END AS stop_ratio, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls,
 CASE WHEN len(ws) > 0 THEN coalesce(covered, 0) / len(ws) ELSE 0 END AS repeated_share FROM w LEFT JOIN c USING (rid))"""

_IDENT = r"regexp_replace(unnest(regexp_extract_all(upper({}), '[A-Z]+[\s_-]*[0-9]+[A-Z0-9]*')), '[\s_-]', '', 'g')"

SQL: dict[str, str] = {
    "p3_found": rf"""WITH RECURSIVE g AS (SELECT DISTINCT dataset, {_IDENT.format('ldo_group')} AS g FROM t1_dataset_manifest), h AS (
 SELECT DISTINCT holdout_group AS h, {_IDENT.format('holdout_group')} AS g FROM split_manifest),
 tie AS (SELECT dataset AS d, 'g' || g AS t FROM g UNION SELECT dataset, 'd' || regexp_extract(lower(regexp_replace(doi, '\s', '', 'g')), '(10\.\d+/.*[a-z0-9])', 1) FROM t1_dataset_manifest
 WHERE regexp_matches(lower(regexp_replace(doi, '\s', '', 'g')), '10\.\d+/.*[a-z0-9]') UNION SELECT dataset, 'h' || h FROM g JOIN h USING (g)),
 pair AS (SELECT DISTINCT a.d AS a, b.d AS b FROM tie a JOIN tie b USING (t)), reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
 SELECT a AS dataset, min(b) AS root_dataset FROM reach GROUP BY a HAVING count(DISTINCT b) > 1""",
    "p5_found": """WITH v AS (SELECT DISTINCT cell_id, CAST(emb AS DOUBLE[]) AS e FROM cell_repr WHERE len(emb) = 64 AND len(list_filter(emb, lambda x: x IS NULL OR isnan(x))) = 0
 AND len(list_filter(emb, lambda x: x <> 0)) > 0), c AS (SELECT a.cell_id AS a, b.cell_id AS b, list_cosine_similarity(a.e, b.e) AS cos FROM v a JOIN v b ON a.cell_id <> b.cell_id),
 t AS (SELECT a, b FROM c WHERE cos >= 0.93 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cos, 12) DESC, b) <= 5)
 SELECT x.a AS cell_id_a, x.b AS cell_id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p8_found": f"WITH {_MEASURED} SELECT doc_id FROM m WHERE repeated_share >= 0.45",
    "p8_quality": f"""WITH {_MEASURED}, q AS (SELECT *, CASE WHEN len(ls) > 0 THEN (len(ls) - len(list_distinct(ls))) / len(ls) ELSE 0 END AS line_repeat_ratio FROM m)
 SELECT doc_id, CAST(n_words AS INT) AS n_words, round(distinct_ratio, 6) AS distinct_ratio, round(symbol_ratio, 6) AS symbol_ratio, round(stop_ratio, 6) AS stop_ratio,
 round(line_repeat_ratio, 6) AS line_repeat_ratio, round(repeated_share, 6) AS repeated_share, n_words <= 2 AS too_short, symbol_ratio >= 0.3 AS symbol_heavy, stop_ratio <= 0.02 AS no_stop_words,
 line_repeat_ratio >= 0.3 AS repeated_lines, repeated_share >= 0.45 AS repetitive FROM q""",
}
