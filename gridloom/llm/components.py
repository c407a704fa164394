"""Records tied by shared identifiers: a persisted table of components, dealt out to splits as wholes.

Records and identifiers are the two sides of a graph whose edges are rows (node, tie), so a
group of any size is a star and never a list of pairs. A round takes the smallest root over
each tie, then over each node's ties, then the root's own root (pointer jumping), and is
written to the shared folder before the next; roots fall to the smallest in a number of
rounds that grows with the logarithm of a chain's length.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.skew import running_total, spread_join
from gridloom.sources.session import cut, discard

FRACTIONS = (("train", 0.6), ("calibration", 0.2), ("test", 0.2))
HEAVY = 0.001  #: share of all weight above which a component is dealt out by itself; there are fewer than 1 / HEAVY
_RECORD, _OTHER = "0", "1"  # first letters of nodes: records come first, so a root is one


def identifiers(text: Column) -> Column:
    """The group identifiers named in a text: letters and a number, glued, upper case."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"([A-Z]+[\s_-]*[0-9]+[A-Z0-9]*)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[\s_-]", "")))


def doi(text: Column) -> Column:
    """The bare DOI, lower case; null where there is none."""
    plain = F.lower(F.regexp_replace(text, r"\s", ""))
    found = F.regexp_extract(plain, r"(10\.\d+/.*[a-z0-9])", 1)
    return F.when(found != "", found)


def ties(manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """(node, tie), distinct: records with a tie in common belong together.

    A joint holdout is a node of its own with the ties of its groups, so it adds as many rows
    as it names groups, however many records they have. Null and placeholder fields give none.
    """
    node = F.concat(F.lit(_RECORD), "dataset").alias("node")
    groups = manifest.select(node, F.explode(identifiers(F.col("ldo_group"))).alias("g")).select("node", F.concat(F.lit("g:"), "g").alias("tie"))
    dois = manifest.select(node, F.concat(F.lit("d:"), doi(F.col("doi"))).alias("tie")).filter("tie IS NOT NULL AND node IS NOT NULL")
    joint = splits.select(F.array_sort(identifiers(F.col("holdout_group"))).alias("gs")).filter(F.size("gs") > 1).distinct()
    held = joint.select(F.concat(F.lit(_OTHER), F.array_join("gs", "+")).alias("node"), F.explode("gs").alias("g"))
    return groups.filter("node IS NOT NULL").unionByName(dois).unionByName(held.select("node", F.concat(F.lit("g:"), "g").alias("tie"))).distinct()


def grown(roots: DataFrame) -> DataFrame:
    """Ties of a persisted component table: each record to its component."""
    return roots.select(F.concat(F.lit(_RECORD), "dataset").alias("node"), F.concat(F.lit("c:"), "root_dataset").alias("tie"))


def components(tied: DataFrame) -> DataFrame:
    """(dataset, root_dataset) of every record tied to another; the root is the smallest of all it hangs together with."""
    tied = cut(tied)
    sizes = cut(tied.groupBy("tie").agg(F.count("*").alias("n")).filter("n > 1"))
    most = tied.count()  # no key has more rows than that
    tied = cut(spread_join(tied, sizes, "tie", "node", most=most))
    whole = roots = cut(tied.select("node", F.col("node").alias("root")).distinct())
    while True:
        of_tie = tied.join(roots, "node").groupBy("tie").agg(F.min("root").alias("r")).join(sizes, "tie")
        best = cut(spread_join(tied, of_tie, "tie", "node", most=most).groupBy("node").agg(F.min("r").alias("r")))
        up = best.select(F.col("node").alias("r"), F.col("r").alias("rr")).join(best.groupBy("r").agg(F.count("*").alias("n")), "r")
        moved = spread_join(best, up, "r", "node", most=most).select("node", F.col("rr").alias("root"))
        after = cut(moved.join(roots.withColumnRenamed("root", "was"), "node"))
        changed = after.filter("root <> was").limit(1).count()
        discard(best, whole)
        whole, roots = after, after.select("node", "root")
        if not changed:
            break
    records = roots.filter(F.col("node").startswith(_RECORD))
    shared = records.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    plain = lambda c: F.substring(c, 2, 1 << 30)
    return spread_join(records, shared, "root", "node", most=most).select(plain("node").alias("dataset"), plain("root").alias("root_dataset"))


def _greedy(heavy: Iterable[tuple[str, float]], room: dict[str, float]) -> list[tuple[str, str]]:
    """The heaviest first, each to the split with the most room; room is used up."""
    out = []
    for root, weight in sorted(heavy, key=lambda x: (-x[1], x[0])):
        to = max(room, key=lambda p: room[p])
        room[to] -= weight
        out.append((root, to))
    return out


def dealt(records: DataFrame, tied: DataFrame, weight: str = "n_donors", fractions: tuple[tuple[str, float], ...] = FRACTIONS, before: DataFrame | None = None) -> DataFrame:
    """(dataset, root_dataset, weight, partition, status) of every record, whole components in one split.

    records has one row per dataset with its weight, null counting 0. `before` is an earlier
    result of this function: its components are tied again by themselves, so they only grow.
    A component whose records had one split keeps it (status kept); one that had none fills
    the splits' deficits (new); one that merges records of different splits is put into
    quarantine as a whole (conflict), and one already there stays there.

    Components of more than HEAVY of all weight, of which there are few, are dealt one by
    one, the heaviest first. All others lie in a fixed random order on a line as long as
    their weight, which is cut by what room is left, so no split is off by more than one of them.
    """
    spark = records.sparkSession
    rows = records.select("dataset", F.coalesce(F.col(weight), F.lit(0)).cast("double").alias("weight")).filter("dataset IS NOT NULL")
    roots = components(tied if before is None else tied.unionByName(grown(before)).distinct())
    placed = cut(rows.join(roots, "dataset", "left").withColumn("root_dataset", F.coalesce("root_dataset", "dataset")))
    old = before.select("dataset", F.col("partition").alias("_old")) if before is not None else placed.select("dataset", F.lit(None).cast("string").alias("_old"))
    whole = cut(
        placed.join(old, "dataset", "left")
        .groupBy("root_dataset")
        .agg(F.sum("weight").alias("_weight"), F.min("_old").alias("_a"), F.max("_old").alias("_b"), F.count("*").alias("n"))
        .select("root_dataset", "_weight", "n", F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_a").isNotNull(), "quarantine").alias("_kept"))
    )
    sums = {r["_kept"]: r["w"] or 0.0 for r in whole.groupBy("_kept").agg(F.sum("_weight").alias("w")).collect()}  # a row per split
    total = sum(sums.values())
    room = {p: f * total - sums.get(p, 0.0) for p, f in fractions}
    new = whole.filter("_kept IS NULL")
    heavy = new.filter(F.col("_weight") > HEAVY * total).select("root_dataset", "_weight").collect() if total else []  # under 1 / HEAVY rows
    one_by_one = spark.createDataFrame(_greedy([tuple(r) for r in heavy], room), "root_dataset string, _to string")
    light = new.filter(F.col("_weight") <= HEAVY * total) if total else new
    left = {p: max(0.0, r) for p, r in room.items()}
    length = sum(left.values()) or 1.0
    line = running_total(light.withColumn("_all", F.lit(1)), ["_all"], "_weight", "root_dataset", "_at")
    rest = total - sum(v for k, v in sums.items() if k is not None) - sum(r["_weight"] for r in heavy)
    # Light components without any weight are spread by their hash.
    spot = (F.col("_at") + F.col("_weight") / 2) / rest if rest > 0 else F.pmod(F.xxhash64("root_dataset"), F.lit(1 << 20)) / float(1 << 20)
    names = list(left)
    to, upto = F.lit(names[-1]), [sum(left[p] for p in names[: n + 1]) / length for n in range(len(names))]
    for p, end in reversed(list(zip(names[:-1], upto[:-1], strict=True))):
        to = F.when(spot < end, p).otherwise(to)
    fresh = line.select("root_dataset", to.alias("_to")).unionByName(one_by_one)
    status = F.when(F.col("_kept") == "quarantine", "conflict").when(F.col("_kept").isNotNull(), "kept").otherwise("new")
    verdict = whole.join(fresh, "root_dataset", "left").select("root_dataset", "n", F.coalesce("_kept", "_to").alias("partition"), status.alias("status"))
    return spread_join(placed, verdict, "root_dataset", "dataset").select("dataset", "root_dataset", "weight", "partition", "status")
