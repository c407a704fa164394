"""Problems 6 and 7: the operators can be reached as queries, over whole tables."""

import __spark_entry__ as entry

ITEM = " ".join(f"word{n}x{n * 7 % 11}" for n in range(40))


def test_p6_and_p7(spark, tmp_path):
    words = ITEM.split()
    rows = [(1, "tok " * 3000), (2, "short"), (3, None), (4, "intro " + " ".join(words[5:25]) + " end"), (5, "intro " + " ".join(words[5:15]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, ITEM)], "item_id long, item_text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    found = entry.queries()
    assert [tuple(r) for r in found["p6_found"](spark, str(tmp_path)).collect()] == [(1,)]
    assert [tuple(r) for r in found["p7_found"](spark, str(tmp_path)).collect()] == [(4, 7)]
