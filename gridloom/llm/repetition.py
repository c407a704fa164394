"""Repetition inside a document: a table of thresholds compiled into one projection.

Every measure is a built-in column expression, so a text is read, measured and judged
inside the scan stage: no shuffle, no Python, no state beyond one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import let, words

#: Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the of and to in a is that for it was on with as by at from an be this are or "
    "der die und das den von zu mit auf im ist des dem ein eine nicht "
    "le la les de des et du un une en que est dans pour par sur "
    "el los las y en un una que por con para del se"
).split()


@dataclass(frozen=True)
class Threshold:
    """One row of the table: a document passes if `low` <= `measure` <= `high`."""

    measure: str
    low: float | None = None
    high: float | None = None

    def compiled(self, measures: Column) -> Column:
        value = measures[self.measure]
        bounds = [value >= self.low] if self.low is not None else []
        bounds += [value <= self.high] if self.high is not None else []
        if not bounds:
            raise ValueError(f"{self.measure} has no bound")
        out = bounds[0]
        for b in bounds[1:]:
            out = out & b
        return F.coalesce(out, F.lit(False))


#: The table: what is reported of every text. A text is spam or a loop by its repeated share;
#: the ratios of length, symbols, stop words and lines describe it, but cannot express that.
QUALITY = {
    "too_short": Threshold("n_words", high=2),
    "symbol_heavy": Threshold("symbol_ratio", low=0.30),
    "no_stop_words": Threshold("stop_ratio", high=0.02),
    "repeated_lines": Threshold("line_repeat_ratio", low=0.30),
    "repetitive": Threshold("repeated_share", low=0.45),
}


MEASURES = ("n_words", "distinct_ratio", "symbol_ratio", "stop_ratio", "line_repeat_ratio", "repeated_share")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def repeated_words(ws: Column, span: int) -> Column:
    """How many words of the array lie in a window of `span` words that occurred before.

    Windows are hashed to 64 bits and sorted with their places (n log n, also for very long
    texts); a window equal to its neighbour in that order is a repeat: of equal windows all
    but the first. Their union is measured by walking the repeats' places in order, so
    overlapping repeats count a word once.
    """

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - span),
            lambda i: F.struct(F.xxhash64(F.slice(h, i + 1, F.lit(span))).alias("g"), i.alias("i")),
        )

    def starts(s: Column) -> Column:
        m = F.size(s) - 1
        again = F.zip_with(
            F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["g"] == b["g"], b["i"])
        )
        return F.sort_array(F.filter(again, lambda i: i.isNotNull()))

    covered = F.aggregate(
        let(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.sort_array(windows(h))), starts),
        F.struct(F.lit(0).alias("n"), F.lit(-span).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(span), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    return F.when(F.size(ws) > span, covered).otherwise(F.lit(0))


def measures(text: Column, span: int = 8) -> Column:
    """The MEASURES of a text as one struct.

    symbol_ratio counts characters that are neither letters, digits nor blanks, and
    line_repeat_ratio non-blank lines that are copies of an earlier one. Null, empty and
    word-less texts measure 0 everywhere and distinct_ratio 1. Windows of `span` words are told
    apart by a 64-bit hash: in a text of a million windows two different ones agree with a
    chance of 3 in 10^8.
    """
    t = F.coalesce(text, F.lit(""))

    def of_words(ws: Column) -> Column:
        n = F.size(ws)
        distinct = F.when(n > 0, F.size(F.array_distinct(ws)) / n).otherwise(F.lit(1.0))
        share = _ratio(repeated_words(ws, span), n)
        length = F.length(t)
        lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        stop = F.size(F.filter(ws, lambda w: w.isin(*sorted(set(STOP_WORDS)))))
        return F.struct(
            n.alias("n_words"),
            distinct.alias("distinct_ratio"),
            _ratio(length - F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")), length).alias("symbol_ratio"),
            _ratio(stop, n).alias("stop_ratio"),
            let(lines, lambda x: _ratio(F.size(x) - F.size(F.array_distinct(x)), F.size(x))).alias("line_repeat_ratio"),
            share.alias("repeated_share"),
        )

    return let(words(text), of_words)


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its MEASURES and one flag per rule of QUALITY; such names may not be in df."""
    clash = ({*MEASURES, *QUALITY}) & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    m = df.withColumn("_measures", measures(F.col(text)))
    return m.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col("_measures")[x].alias(x) for x in MEASURES],
        *[r.compiled(F.col("_measures")).alias(k) for k, r in QUALITY.items()],
    )


def repetitive(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that the table finds repetitive, as they are. Null and empty texts are not."""
    return quality(df, text).filter("repetitive").select(*[F.col(f"`{c}`") for c in df.columns])
