"""The repeated share against brute force, the table's flags, odd rows."""

import random
import re

import pytest

from gridloom.llm import repetition


def _share(text, span=8):
    ws = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    seen, covered = set(), set()
    for i in range(len(ws) - span + 1):
        k = tuple(ws[i : i + span])
        covered |= set(range(i, i + span)) if k in seen else set()
        seen.add(k)
    return len(covered) / len(ws) if ws else 0.0


def test_share_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " .,; ", "a b", "one " * 8, "one " * 9, "one " * 30000]
    for _ in range(150):
        base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 40))]
        texts.append((" " if rng.random() < 0.5 else ", ").join(base * rng.randint(1, 4) + base[: rng.randint(0, 20)]))
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in repetition.quality(df).collect()}
    for n, t in enumerate(texts):
        assert got[n]["repeated_share"] == pytest.approx(_share(t)) and got[n]["repetitive"] == (_share(t) >= 0.45)
    assert {r["doc_id"] for r in repetition.repetitive(df).collect()} == {n for n, t in enumerate(texts) if _share(t) >= 0.45}


def test_other_ratios(spark):
    df = spark.createDataFrame([("#$%&!", 1), ("the cat and the dog", 2), ("x y z\nx y z\n\nq r s", 3)], "text string, doc_id int")
    a, b, c = repetition.quality(df).orderBy("doc_id").collect()
    assert a["symbol_heavy"] and a["too_short"] and b["stop_ratio"] == pytest.approx(0.6) and not b["no_stop_words"]
    assert c["line_repeat_ratio"] == pytest.approx(1 / 3) and c["repeated_lines"]


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id int, text string, n_words int")
    with pytest.raises(ValueError):
        repetition.quality(df)
    assert repetition.quality(df.drop("n_words").limit(0)).count() == 0
