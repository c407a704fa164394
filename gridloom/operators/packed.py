"""Packed lists as one row per value, each text read in the notation that describes it shortest.

A dialect is a set of delimiters, of quotes and, where values carry scores, of the signs
between name and score. A text's description in a dialect costs the dialect itself, its
delimiters and its values; a value that many texts hold costs the logarithm of how rare it
is, any other is spelt out letter by letter. The wrong dialect glues or breaks values,
which nobody else has, so it costs more.

1. Every text is parsed in each dialect that could apply, and each value counts once a text.
   The counts are added up distributedly, and once more for the cheapest parses.
2. Values above a support, of which there are at most MOST_CODES, form the code table. It is
   broadcast; rarer values cost what they are long either way.
3. Every text is parsed in its cheapest dialect.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for a missing field, and for a missing score.
PLACEHOLDERS = {"", "na", "n/a", "none", "null", "nan", "-", "{}", "[]", "unknown"}
NO_SCORE = {"", "null", "none", "nan", "na", "n/a", "-"}
#: Characters that may part values. Commas and semicolons of other scripts among them.
DELIMITERS = ",;|\t\n\r；，、｜"
ANY = DELIMITERS

MOST_CODES = 200_000  #: values of the code table; a few MB in each task
LETTER = 7.0  #: bits of a letter that is spelt out
DIGIT = 3.4  #: bits of a digit of a score
RARE = 8.0  #: bits that say a value is spelt out
MARK = 1.0  #: bits of a delimiter
PART = 9.0  #: bits of a piece of text between values that a dialect has no place for


@dataclass(frozen=True)
class Dialect:
    """How texts may be written; `bits` is what it costs to name the dialect."""

    delimiters: str
    quotes: str
    scored: str = ""  # the signs between a name and its score; empty for plain lists
    bits: float = 2.0
    pair: re.Pattern = field(init=False, compare=False, repr=False)
    parts: re.Pattern = field(init=False, compare=False, repr=False)
    idle: dict = field(init=False, compare=False, repr=False)  # letters that no value needs

    def __post_init__(self) -> None:
        object.__setattr__(self, "pair", _pairs(self) if self.scored else None)
        object.__setattr__(self, "parts", re.compile(f"[{re.escape(self.delimiters)}]"))
        object.__setattr__(self, "idle", dict.fromkeys(map(ord, self.delimiters + "[]{} \t\n\r\xa0")))


def _pairs(d: Dialect) -> re.Pattern:
    """A name, a sign and a score up to a delimiter or closing bracket."""
    forms = {'"': r'"(?:\\.|""|[^"\\])*"', "'": r"'(?:\\.|''|[^'\\])*'"}
    stop = re.escape(d.delimiters.replace("\r", ""))
    signs = re.escape(d.scored)
    # A quote that the dialect does not know is a letter; one inside a name is a letter in any dialect.
    bare = rf"[^\s{signs}{stop}\[\]{{}}{re.escape(d.quotes)}](?:\\.|[^{signs}{stop}\\])*?"
    name = "|".join([*(forms[q] for q in d.quotes), bare])
    return re.compile(rf"(?:\A|(?<=[\s{stop}\[{{]))({name})[ \t]*[{signs}][ \t]*([^{stop}\]}}]*?)\s*(?=[{stop}\]}}]|\Z)", re.S)


_SINGLE = [*";,|\t；，、｜", "\n\r"]
#: One delimiter and one kind of quote, or none; then all delimiters and quotes together.
LISTS = (
    *(Dialect(d, q) for d in _SINGLE for q in ("", '"', "'")),
    Dialect(ANY, "", bits=3.0),
    Dialect(ANY, "\"'", bits=3.5),
)
SCORES = (
    *(Dialect(d, q, s, bits=3.0) for d in (",", ";", "|", "\n\r", "；", "，") for q in ("", '"', "'") for s in (":", "=")),
    *(Dialect(",", q, ",", bits=4.0) for q in ('"', "'")),  # lists of pairs
    Dialect(ANY, "\"'", ":=：,", bits=6.0),
)


def unquote(raw: str) -> str:
    """A name without its quotes, escapes and outer blanks."""
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        q, raw = raw[0], raw[1:-1]
        if q == '"' and '""' not in raw:
            try:
                return json.loads(f'"{raw}"', strict=False).strip()
            except ValueError:
                pass
        raw = raw.replace(q + q, q)
    return re.sub(r"\\(.)", r"\1", raw, flags=re.S).strip()


def _decoded(text: str) -> str:
    """JSON that was packed into a JSON string once more is taken out of it, cut off or not."""
    text = text.strip()
    if re.match(r'"\s*[\[{]', text):
        text = re.sub(r"\\(.)", r"\1", text[1:-1] if text.endswith('"') and not text.endswith('\\"') else text[1:]).strip()
    return text


def split_list(text: str, dialect: Dialect) -> list[str]:
    """The values of a decoded text, in written order; empty places give none, a cut-off last value neither."""
    bracketed = text.startswith("[")
    cut = bracketed and not text.endswith("]")
    if bracketed:
        text = text[1:] if cut else text[1:-1]
    if "\\" not in text and not any(q in text for q in "\"'"):
        # Nothing is protected: every delimiter parts.
        plain = [x.strip() for x in dialect.parts.split(text)]
        return [x for x in (plain[:-1] if cut else plain) if x]
    out, n, at = [], len(text), 0
    while at <= n:
        while at < n and text[at].isspace() and text[at] not in dialect.delimiters:
            at += 1
        begin, whole = at, not cut
        if at < n and text[at] in dialect.quotes:
            q, end = text[at], at + 1
            while end < n:
                if text[end] == "\\":
                    end += 2
                    continue
                if text[end] == q:
                    if text[end + 1 : end + 2] == q and text[end + 2 : end + 3] not in ("", *dialect.delimiters):
                        end += 2
                        continue
                    rest = text[end + 1 :].lstrip(" \xa0")
                    if not rest or rest[0] in dialect.delimiters:
                        break
                end += 1
            if end < n:
                at, whole = end + 1, True
        while at < n and text[at] not in dialect.delimiters:
            at += 2 if text[at] == "\\" else 1
        at = min(at, n)
        raw = text[begin:at]
        item = unquote(raw) if dialect.quotes or raw[:1] not in "\"'" else re.sub(r"\\(.)", r"\1", raw, flags=re.S).strip()
        if item and (whole or at < n):
            out.append(item)
        at += 1
    return out


def split_scores(text: str, dialect: Dialect) -> tuple[list[tuple[str, str]], int]:
    """(name, score as written or "") of each complete pair of a decoded text, and how many letters no pair took."""
    cut = (text[:1] == "{" and not text.endswith("}")) or (text[:1] == "[" and not text.endswith("]"))
    out, taken = [], 0
    for m in dialect.pair.finditer(text):
        if cut and m.end() == len(text):
            break
        score = m.group(2).strip().strip("\"'").strip()
        name = unquote(m.group(1))
        if name:
            out.append((name, "" if score.lower() in NO_SCORE else score))
            taken += m.end() - m.start()
    left = len(text.translate(dialect.idle)) - taken
    return out, max(0, left)


def parses(text: str | None, scored: bool) -> Iterator[tuple[list[tuple[str, str]], float]]:
    """(values with scores, bits without the values) of a text in each dialect that could apply."""
    text = _decoded(text or "")
    if text.lower() in PLACEHOLDERS:
        return
    plain = True
    if scored:
        for d in SCORES:
            if any(c in text for c in d.scored) and (not d.quotes or any(q in text for q in d.quotes)) and (len(d.delimiters) > 2 or any(c in text for c in d.delimiters) or d.delimiters == ","):
                got, left = split_scores(text, d)
                if got:
                    plain = False
                    spelt = sum(DIGIT * len(v) if re.fullmatch(r"[-+0-9.eE]*", v) else LETTER * len(v) + RARE for _, v in got)
                    yield got, d.bits + MARK * len(got) + spelt + (PART + LETTER * left if left else 0.0)
        plain = plain and text[0] not in "[{"
    if plain:
        single = not any(c in text for c in DELIMITERS)
        for d in LISTS:
            if (any(c in text for c in d.delimiters) or (single and d.delimiters == ";")) and (not d.quotes or any(q in text for q in d.quotes)):
                got = split_list(text, d)
                yield [(x, "") for x in got], d.bits + MARK * len(got)


class Codes:
    """Bits of a value: from how many texts hold it, or spelt out."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values())
        self.known = {v: math.log2(total / n) for v, n in counts.items()} if total else {}

    def __call__(self, value: str) -> float:
        spelt = RARE + LETTER * len(value)
        return min(self.known.get(value, spelt), spelt)


def cheapest(text: str | None, scored: bool, codes: Codes) -> list[tuple[str, str]]:
    """The text's values in the dialect of the shortest description; the first of equal ones."""
    best, least = [], math.inf
    for got, bits in parses(text, scored):
        bits += sum(codes(name) for name, _ in got)
        if got and bits < least - 1e-9:
            best, least = got, bits
    return best


def value_counts(df: DataFrame, fields: dict[str, bool], table: dict[str, int] | None = None) -> DataFrame:
    """(value, n): in how many texts a value comes up, in any dialect, or with a table in the cheapest one.

    Values of one text and long ones are left out, as they are spelt anyway.
    """
    shared = df.sparkSession.sparkContext.broadcast(table)

    def count(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for frame in frames:
            seen: dict[str, int] = {}
            codes = Codes(shared.value) if shared.value is not None else None
            for name, scored in fields.items():
                for text in frame.column(name).to_pylist():
                    if text:
                        ways = (got for got, _ in parses(text, scored)) if codes is None else [cheapest(text, scored, codes)]
                        for v in {x for got in ways for x, _ in got}:
                            seen[v] = seen.get(v, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["value", "n"])

    part = df.select(*[F.col(f"`{f}`") for f in fields]).mapInArrow(count, "value string, n bigint")
    return part.groupBy("value").agg(F.sum("n").alias("n")).filter((F.col("n") > 1) & (F.length("value") <= 200))


def code_table(sources: list[tuple[DataFrame, dict[str, bool]]]) -> dict[str, int]:
    """The value counts of all (table, fields) as one dictionary, of at most MOST_CODES values.

    Counted twice: first over all dialects, then over the cheapest ones by the first count,
    which frees the table of values that two wrong parses have in common. More than
    MOST_CODES are cut by support: a rarer value is spelt out like any other rare one, which
    bounds the broadcast and changes costs by little.
    """
    table: dict[str, int] | None = None
    for _ in range(2):
        every = None
        for df, fields in sources:
            one = value_counts(df, fields, table)
            every = one if every is None else every.unionByName(one)
        sums = every.groupBy("value").agg(F.sum("n").alias("n"))
        table = {r["value"]: r["n"] for r in sums.orderBy(F.desc("n"), "value").limit(MOST_CODES).collect()}
    return table


def unpacked(df: DataFrame, key: str, fields: dict[str, bool], table: dict[str, int] | None = None) -> DataFrame:
    """(field, row_key, pos, item, amount) for each value of the fields; True marks scores.

    pos counts from 1 in written order. Null, blank and placeholder texts give no row, a
    repeated row gives its values again, a null key stays null, other columns are not read.
    The table is that of code_table(); without one it is made from df.
    """
    table = code_table([(df, fields)]) if table is None else table
    shared = df.sparkSession.sparkContext.broadcast(table)

    def read(frames: Iterator) -> Iterator:
        import pyarrow as pa

        codes = Codes(shared.value)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for frame in frames:
            keys = frame.column("_key").to_pylist()
            for name, scored in fields.items():
                rows: list[tuple] = []
                for k, text in zip(keys, frame.column(name).to_pylist(), strict=True):
                    if text:
                        rows += [(name, k, n, *pair) for n, pair in enumerate(cheapest(text, scored, codes), 1)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["field", "row_key", "pos", "item", "amount"])

    cols = [F.col(f"`{key}`").cast("string").alias("_key"), *[F.col(f"`{f}`") for f in fields]]
    return df.select(*cols).mapInArrow(read, "field string, row_key string, pos int, item string, amount string")
