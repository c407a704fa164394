"""Labels typed by hand onto a reference list: distinct values, an n-gram index, cosine and margin.

Every distinct value is looked at once, wherever it was typed. It is folded to plain letters and
freed of remarks around the name; numbers of the ontology count by their digits. Then the names
that share character n-grams with it come out of an inverted index with their cosine, rare
n-grams weighing more, and the best class is taken if its cosine reaches THRESHOLD and leads the
next class by MARGIN. An exact check follows: few edits for the name's length, the same digits.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.folding import fold
from gridloom.llm.skew import spread_join
from gridloom.sources.session import cut

THRESHOLD = 0.3  #: least cosine of an accepted name; a short name with one letter wrong has little more
MARGIN = 0.02  #: lead over the best name of any other class; equal ones are decided by fewer edits
MOST_REFERENCE = 1_000_000  #: names of a reference list, which every task holds
_NUMBER = re.compile(r"(?<!\d)\d{7}(?!\d)")
_BEFORE = re.compile(r"^\W*(?:(?:likely|prob|probably|possibly|maybe|putative|cf)\b\.?\s*|c?\d+\s*[_:]\s*)+")
_AFTER = re.compile(r"\(\s*ann\b[^)]*\)?|#\s*\d+|/\s*batch\s*\d+|\s-\s+core side\b|\s![^!]*$")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text)


def _edits(a: str, b: str, most: int) -> int:
    """Edits with neighbours swapped as one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 7 else 2 if n < 12 else 3


def _grams(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in words:
        for g in [w[i : i + 2] for i in range(len(w) - 1)] or [w]:
            out[g] = out.get(g, 0) + 1
    return out


class Mapper:
    """The class a typed label means, 0 if none; answers are remembered."""

    def __init__(self, reference: list[tuple[int, list[str], str]]):
        self.numbers = {m.group(): c for c, _, term in reference for m in [_NUMBER.search(term)] if m}
        self.names = [(c, _words(fold(n))) for c, names, _ in reference for n in names]
        self.exact: dict[str, int] = {}
        for c, ws in self.names:
            self.exact.setdefault("".join(ws), c)
        for c, ws in self.names:
            for p in itertools.permutations(ws):
                self.exact.setdefault("".join(p), c)
        for k, c in list(self.exact.items()):
            self.exact.setdefault(k + "s", c)
        grams = [_grams(ws) for _, ws in self.names]
        seen: dict[str, int] = {}
        for x in grams:
            for g in x:
                seen[g] = seen.get(g, 0) + 1
        self.weight = {g: 1 + math.log(len(grams) / n) for g, n in seen.items()}
        self.most = 1 + math.log(max(1, len(grams)))
        #: The inverted index: for each n-gram the names that have it, with its part of their unit vectors.
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for n, x in enumerate(grams):
            v = self._weighted(x)
            for g, w in v.items():
                self.postings.setdefault(g, []).append((n, w))

    def _weighted(self, grams: dict[str, int]) -> dict[str, float]:
        """A unit vector; an n-gram that no name has weighs as much as the rarest."""
        v = {g: n * self.weight.get(g, self.most) for g, n in grams.items()}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        return {g: w / norm for g, w in v.items()}

    def near(self, ws: list[str]) -> list[tuple[float, int]]:
        """(cosine, name) of all names that share an n-gram, best first."""
        score: dict[int, float] = {}
        for g, w in self._weighted(_grams(ws)).items():
            for n, x in self.postings.get(g, ()):
                score[n] = score.get(n, 0.0) + w * x
        return sorted(((c, n) for n, c in score.items()), key=lambda x: (-x[0], x[1]))

    def __call__(self, text: str) -> int:
        return self._find(text)

    def nearest(self, text: str) -> tuple[str, float]:
        """The name nearest to a text and its cosine, "" and 0 if nothing is shared."""
        got = self.near(_words(self._bare(fold(text))))[:1]
        return (" ".join(self.names[got[0][1]][1]), got[0][0]) if got else ("", 0.0)

    @staticmethod
    def _bare(t: str) -> str:
        """A folded text without remarks before and after the name."""
        return _AFTER.sub(" ", _BEFORE.sub("", _AFTER.sub(" ", t)))

    def _find(self, text: str) -> int:
        t = fold(text)
        number = _NUMBER.search(t)
        if number:
            return self.numbers.get(number.group(), 0)
        bare = self._bare(t)
        for v in (t, bare):
            if "".join(_words(v)) in self.exact:
                return self.exact["".join(_words(v))]
        ws = _words(bare)
        if not ws:
            return 0
        return self._shortened(bare, ws) or self._misspelt(ws)

    def _shortened(self, text: str, ws: list[str]) -> int:
        """A name whose last word is cut short by a full stop, or only says that it is a cell."""
        if len(ws) < 2 or not (ws[-1] in ("cell", "cells") or re.search(r"[^\W_]\.\W*$", text)):
            return 0
        head, tail = ws[:-1], ws[-1]
        for fits in (
            {c for c, x in self.names if len(x) == len(ws) and x[:-1] == head and x[-1].startswith(tail)},
            {c for c, x in self.names if x == head},
            {c for c, x in self.names if x[: len(head)] == head},
        ):
            if len(fits) == 1:
                return fits.pop()
        return 0

    def _misspelt(self, ws: list[str]) -> int:
        """The best name by cosine, with MARGIN to other classes, that few enough edits turn the text into."""
        squeezed = "".join(ws)
        digits = re.sub(r"\D", "", squeezed)
        near = [x for x in self.near(ws) if x[0] >= THRESHOLD]
        best: dict[int, tuple[int, float]] = {}
        for cos, n in near:
            c, name = self.names[n]
            joined = "".join(name)
            if re.sub(r"\D", "", joined) != digits:
                continue
            most = _allowed(len(joined))
            for p in itertools.permutations(name):
                for v in (squeezed, squeezed.removesuffix("s")):
                    d = _edits(v, "".join(p), most)
                    if d <= most:
                        best[c] = min(best.get(c, (99, 0.0)), (d, -cos))
        if not best:
            return 0
        ranked = sorted((d, cos, c) for c, (d, cos) in best.items())
        if len(ranked) == 1 or ranked[0][0] < ranked[1][0]:
            return ranked[0][2]
        # As few edits to two classes: the cosine must tell them apart.
        return ranked[0][2] if ranked[1][1] - ranked[0][1] >= MARGIN else 0


def _reference(reference: DataFrame) -> list[tuple[int, list[str], str]]:
    rows = reference.select("class_id", "working_class", "preferred_label", "aliases", "cl_term").limit(MOST_REFERENCE + 1).collect()
    if len(rows) > MOST_REFERENCE:
        raise ValueError(f"a reference list of more than {MOST_REFERENCE} classes does not fit a task")
    return [(r[0], [x for x in (r[1], r[2], *(r[3] or [])) if x], r[4] or "") for r in rows if r[0] is not None]


def values_of(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, n, class_id, nearest, cosine): each distinct value once, with its number of rows.

    values has one column, value. Null and blank ones are left out. class_id is 0 where no
    class is meant; nearest is the name with the greatest cosine, however small.
    """
    shared = values.sparkSession.sparkContext.broadcast(_reference(reference))
    distinct = values.filter(F.col("value").isNotNull() & (F.regexp_replace("value", r"\s", "") != "")).groupBy("value").agg(F.count("*").alias("n"))

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = Mapper(shared.value)
        for f in frames:
            found = [mapper.nearest(t) for t in f["value"]]
            yield f.assign(class_id=[mapper(t) for t in f["value"]], nearest=[x for x, _ in found], cosine=[x for _, x in found])

    return distinct.mapInPandas(match, "value string, n bigint, class_id int, nearest string, cosine double")


def classed(df: DataFrame, reference: DataFrame, field: str, by: str) -> DataFrame:
    """df with class_id of the field, null where it is null or blank; by is a unique column."""
    found = cut(values_of(df.select(F.col(field).alias("value")), reference)).select("value", "n", "class_id")
    blank = F.coalesce(F.regexp_replace(field, r"\s", "") == "", F.lit(True))
    meant = spread_join(df.filter(~blank).withColumn("value", F.col(field)), found, "value", by).drop("value")
    return meant.unionByName(df.filter(blank).withColumn("class_id", F.lit(None).cast("int")))


def mapped(df: DataFrame, reference: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, class_id) for each field that is neither null nor blank; 0 means no class.

    Values are matched once each and joined back; a value that a third of all rows have is
    spread over many tasks. Repeated keys give repeated rows; other columns are not read.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields]))
    typed = df.select(F.col(f"`{key}`").alias("_id"), each.alias("_x")).select("_id", "_x.field", "_x.value")
    typed = typed.filter(F.col("value").isNotNull() & (F.regexp_replace("value", r"\s", "") != ""))
    found = cut(values_of(typed.select("value"), reference)).select("value", "n", "class_id")
    return spread_join(typed, found, "value", "_id").select(F.col("_id").alias(key), "field", "class_id")
