"""Packed lists: notations by hand, a round trip through random dialects, odd rows."""

import json
import random

from gridloom.operators import packed

NAMES = ["Alpha_T4", "Mono/Lorr", "Gamma+ cell", "Merrow's touch cell", "P; m", "T, c", 'Cyclo "dividing" pool', "Beta", "Delta_Reg", "Omega|x"]
COMMON = {n: 50 for n in NAMES}


def names(text):
    return [x for x, _ in packed.cheapest(text, False, packed.Codes(COMMON))]


def pairs(text):
    return packed.cheapest(text, True, packed.Codes(COMMON))


def test_notations():
    assert names("Beta; Alpha_T4,Delta_Reg|Mono/Lorr||  ;Delta_Reg") == ["Beta", "Alpha_T4", "Delta_Reg", "Mono/Lorr", "Delta_Reg"]
    assert names('["Beta", "Cyclo \\"dividing\\" pool"]') == ["Beta", 'Cyclo "dividing" pool']
    assert names("Beta;Merrow's touch cell;'P; m'") == ["Beta", "Merrow's touch cell", "P; m"]
    assert names('Beta|"Cyclo ""dividing"" pool"|T\\, c') == ["Beta", 'Cyclo "dividing" pool', "T, c"]
    assert names("NA") == names(" - ") == names(None) == names("") == []
    assert names('["Beta", "Alph') == ["Beta"] and names('"Beta"') == ["Beta"]


def test_a_name_with_a_delimiter_stays_whole_if_it_is_common():
    assert names("Beta|T, c|Delta_Reg") == ["Beta", "T, c", "Delta_Reg"]
    assert names("Beta|Alpha_T4, Delta_Reg") == ["Beta", "Alpha_T4", "Delta_Reg"]


def test_scores():
    assert pairs('{"Beta": 0.50, "Alpha_T4":NaN, "T, c": 5.3e-01}') == [("Beta", "0.50"), ("Alpha_T4", ""), ("T, c", "5.3e-01")]
    assert pairs('[["Beta", 0.5], ["Alpha_T4", null]]') == [("Beta", "0.5"), ("Alpha_T4", "")]
    assert pairs("Beta=; Alpha_T4=0.6") == [("Beta", ""), ("Alpha_T4", "0.6")]
    assert pairs('"{\\"Beta\\":0.3, \\"Alpha_T4\\": 1.00}"') == [("Beta", "0.3"), ("Alpha_T4", "1.00")]
    assert pairs('{"Beta": 0.5, "Alpha_T4": 0.6, "Gamma": 0.') == [("Beta", "0.5"), ("Alpha_T4", "0.6")]


def _write(rng, items):
    delimiter, quote = rng.choice([";", ",", "|", "; ", ", ", " | ", "\t"]), rng.choice(['"', "'"])
    if rng.random() < 0.2:
        return json.dumps(items)
    out = []
    for x in items:
        special = any(c in x for c in packed.DELIMITERS + "\"'")
        out.append(quote + x.replace(quote, quote * 2) + quote if special or rng.random() < 0.2 else x)
    return delimiter.join(out)


def test_round_trip(spark):
    rng = random.Random(1)
    want = {str(n): [rng.choice(NAMES) for _ in range(rng.randint(1, 7))] for n in range(400)}
    df = spark.createDataFrame([(k, _write(rng, v), 1) for k, v in want.items()], "key string, packed string, pos int")
    got = {}
    for r in packed.unpacked(df, "key", {"packed": False}).orderBy("row_key", "pos").collect():
        got.setdefault(r["row_key"], []).append(r["item"])
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.99 * len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "x;y"), ("b", " "), ("c", "x;y"), ("c", "x;y"), ("d", "z;" * 20000)], "k string, f string")
    got = packed.unpacked(df, "k", {"f": False})
    assert got.filter("row_key IS NULL").count() == 2 and got.filter("row_key = 'c'").count() == 4 and got.filter("row_key = 'd'").count() == 20000
    assert packed.unpacked(df.limit(0), "k", {"f": False}).count() == 0
