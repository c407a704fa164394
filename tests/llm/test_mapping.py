"""Typed labels on a reference list: every dirt by hand, odd rows, repeated values."""

from gridloom.llm import mapping

REFERENCE = [
    (101, ["Velarin_T4", "Velarin T4 cell", "VCD4+ lymphocyte"], "CL:9000011"),
    (102, ["Velarin_T8", "Velarin T8 cell", "VCD8+ lymphocyte"], "CL:9055444"),
    (104, ["Bornal", "Bornal lymphocyte", "BoL"], "CL:9166310"),
    (105, ["Bornal_Plasm", "Plasm-forming bornal"], "CL:9221743"),
]
MEANT = {
    "Vélárïn T8 céll": 102, "likely T4, Velarin (ann. 3)": 101, "Bonal lmyphocyte": 104, "VCD4+ cells": 101, "Plasm, Bornal": 105,
    "Bornal lymp.": 104, "obo:CL_9221743": 105, "CL:9221744": 0, "Hexaplume": 0, "doublet": 0, "velarin_t9": 0, "BORNAL": 104,
}


def test_typed_by_hand():
    m = mapping.Mapper(REFERENCE)
    assert {t: m(t) for t in MEANT} == MEANT


def test_index_orders_by_weighted_cosine():
    m = mapping.Mapper(REFERENCE)
    got = m.near(["bornal", "plasm"])
    assert abs(got[0][0] - 1) < 1e-9 and m.names[got[0][1]][0] == 105
    assert all(a[0] >= b[0] for a, b in zip(got, got[1:]))


def test_rows(spark):
    ref = spark.createDataFrame([(c, n[0], t, n[1], n[2:] or None) for c, n, t in REFERENCE], "class_id int, working_class string, cl_term string, preferred_label string, aliases array<string>")
    rows = [(1, "Bornal", None), (2, " ", "CL:9000011"), (3, None, "Bornal"), (3, None, "Bornal"), (4, "x" * 5000, "?")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string").selectExpr("*", "1 AS value", "2 AS n", "3 AS field")
    got = sorted(tuple(r) for r in mapping.mapped(df, ref, "row_id", ["a", "b"]).collect())
    assert got == [(1, "a", 104), (2, "b", 101), (3, "b", 104), (3, "b", 104), (4, "a", 0), (4, "b", 0)]
    assert mapping.mapped(df.limit(0), ref, "row_id", ["a"]).count() == 0
    assert {r["class_id"] for r in mapping.mapped(df, ref.limit(0), "row_id", ["a"]).collect()} == {0}
    classed = mapping.classed(df.select("row_id", "a", "b"), ref, "a", "row_id")
    assert sorted((r["row_id"], r["class_id"]) for r in classed.collect() if r["class_id"] is not None) == [(1, 104), (4, 0)]


def test_unmatched_report(spark):
    ref = spark.createDataFrame([(c, n[0], t, n[1], n[2:] or None) for c, n, t in REFERENCE], "class_id int, working_class string, cl_term string, preferred_label string, aliases array<string>")
    got = {r["value"]: r for r in mapping.values_of(spark.createDataFrame([("Bornalx zzz",), ("Bornalx zzz",), ("Bornal",)], "value string"), ref).collect()}
    assert got["Bornalx zzz"]["n"] == 2 and got["Bornalx zzz"]["class_id"] == 0 and 0 < got["Bornalx zzz"]["cosine"] < 1 and got["Bornal"]["class_id"] == 104
