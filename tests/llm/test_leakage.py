"""Leaks against planted cases: short words, edits, hot passages, broken words, odd rows."""

import random
import time

import numpy as np

from gridloom.llm import leakage


def _words(rng, n, low, high):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high))) for _ in range(n)]


def _recall(low, high, n, edits, even, seed=3):
    rng = random.Random(seed)
    items = [(k, " ".join(_words(rng, 60, low, high))) for k in range(100)]
    texts = []
    for _, t in items:
        part = t.split()[10 : 10 + n]
        at = [(e + 1) * n // (edits + 1) for e in range(edits)] if even else sorted(rng.sample(range(n), edits))
        for p in reversed(at):
            part[p : p + rng.choice([1, 1, 0])] = rng.choice([[], _words(rng, 1, low, high)])
        texts.append(" ".join(_words(rng, 20, 3, 7) + part + _words(rng, 20, 3, 7)))
    found = leakage.leaks_of(leakage.Index(items), texts)
    assert all(a == b for a, b in found)
    return len(found) / 100


def test_exact_runs_of_any_word_length():
    assert _recall(1, 3, 14, 0, True) >= 0.95
    assert _recall(4, 4, 14, 0, True) == 1.0
    assert _recall(3, 9, 14, 0, True) == 1.0


def test_edited_stretches():
    assert _recall(3, 7, 34, 4, True) >= 0.95
    assert _recall(3, 7, 40, 5, False) >= 0.95
    assert _recall(2, 4, 34, 3, True) >= 0.9


def test_shorter_overlaps_are_no_leaks():
    rng = random.Random(4)
    items = [(k, " ".join(_words(rng, 60, 3, 7))) for k in range(40)]
    texts = [" ".join(_words(rng, 20, 3, 7) + t.split()[5:16] + _words(rng, 20, 3, 7)) for _, t in items]
    assert leakage.leaks_of(leakage.Index(items), texts) == set()


def test_markup_case_breaks_and_accents_do_not_count():
    rng = random.Random(5)
    words = _words(rng, 40, 5, 8)
    text = "Intro <b>" + " ".join(words[3:8]).upper() + "</b>, " + words[8][:3] + "\n" + words[8][3:] + " — ".join(["", *words[9:20]]).replace("e", "é")
    assert leakage.leaks_of(leakage.Index([(1, " ".join(words))]), [leakage.fold_words(text)]) == {(0, 0)}


def test_a_passage_that_many_items_share():
    rng = random.Random(6)
    shared = _words(rng, 40, 3, 7)
    items = [(k, " ".join(_words(rng, 10, 3, 7) + shared + _words(rng, 10, 3, 7))) for k in range(300)]
    texts = [" ".join(_words(rng, 30, 3, 7) + shared) for _ in range(50)]
    index, began = leakage.Index(items), time.time()
    assert len(leakage.leaks_of(index, texts)) == 300 * 50
    assert time.time() - began < 30


def test_rows_nulls_and_types(spark):
    item = " ".join(f"word{n}x{n * 7 % 11}" for n in range(40))
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, item, 5), (3, item, 6), (4, "no", 7)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, " ", 1), (10, "few words", 1)], "item_id int, item_text string, doc_id int")
    got = leakage.leaks(docs, items)
    assert got.dtypes == [("doc_id", "bigint"), ("item_id", "int")]
    assert [tuple(r) for r in got.collect()] == [(3, 7), (3, 7)]
    assert leakage.leaks(docs.limit(0), items).count() == leakage.leaks(docs, items.limit(0)).count() == 0


def _overlaps():
    """Items, and texts of short overlaps with them: many hits, all but the last text's without a leak."""
    rng = random.Random(8)
    items = [(k, " ".join(_words(rng, 400, 3, 7))) for k in range(100)]
    parts = [t.split() for _, t in items]
    texts = []
    for _ in range(2000):
        text = []
        for _ in range(10):
            at = rng.randrange(390)
            text += rng.choice(parts)[at : at + 9] + _words(rng, 5, 3, 7)
        texts.append(" ".join(text))
    return items, [*texts, " ".join(parts[7][100:120])]


def test_hits_are_checked_in_little_time():
    items, texts = _overlaps()
    index = leakage.Index(items)
    times = [time.process_time()]
    sum(range(10_000_000))  # the unit, so that a slow machine doesn't count
    times.append(time.process_time())
    assert leakage.leaks_of(index, texts) == {(2000, 7)}
    times.append(time.process_time())
    unit, took = np.diff(times)
    assert took < 5 * unit


def test_whole_words_against_a_loop():
    rng = random.Random(9)
    vocab = [*_words(rng, 12, 1, 3), *_words(rng, 4, 9, 12), "a", "aa"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for k in range(20)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 30))) for _ in range(20)]
    index = leakage.Index(items)
    stream, _, _, offsets, _ = leakage.squeeze(texts)
    cases = sorted((d, k, s) for d in range(20) for k in range(20) for s in rng.sample(range(-120, 121), 12))
    row, word = index.whole_words(stream, offsets, *(np.array(x) for x in zip(*cases, strict=True)))
    expected = []
    for n, (d, k, s) in enumerate(cases):
        text, at = texts[d].replace(" ", ""), s
        for w, one in enumerate(items[k][1].split()):
            if at >= 0 and text[at : at + len(one)] == one:
                expected.append((n, int(index.first[k]) + w))
            at += len(one)
    assert len(expected) > 400
    assert list(zip(row.tolist(), word.tolist(), strict=True)) == expected


def test_pieces_are_refused_by_their_words_only():
    rng = random.Random(10)
    vocab = [*_words(rng, 30, 1, 6), "é", "字", "x" * 30]
    item = " ".join(rng.choices(vocab, k=50))
    one = leakage.Index([(1, item)]).items[0]
    held = 0
    for n in range(400):
        words = item.split()[: rng.randint(0, 50)]
        for _ in range(n % 12):
            words = [w if rng.random() > 0.05 else rng.choice(vocab) for w in words]
        piece = "".join(words).encode()
        missing = np.array([w not in piece for w in one.parts], np.int64)
        held += (expected := leakage._has_stretch(missing, 30, leakage.EDITS))
        assert leakage._may_hold(one, np.frombuffer(piece, np.uint8), 30) == expected
    assert 50 < held < 350
