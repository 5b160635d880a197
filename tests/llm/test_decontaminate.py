from __future__ import annotations

import math
import random

import numpy as np

from touchline.llm import decontaminate, words
from tests.llm.fixtures import awkward_texts, docs, empty, sentence


def items(rnd, n):
    return [(i, " ".join(sentence(rnd, rnd.randint(5, 12)) for _ in range(rnd.randint(1, 4)))) for i in range(n)]


def index_of(rows):
    terms = [set(decontaminate.item_words(t.encode()).view(np.int64).tolist()) for _, t in rows]
    df = {}
    for t in terms:
        for x in t:
            df[x] = df.get(x, 0) + 1
    total = sum(len(decontaminate.item_words(t.encode())) for _, t in rows)
    return decontaminate.BlockMaxIndex(rows, df, len(rows), total / len(rows)), df, total


def test_retrieval_is_exact_above_the_threshold():
    """Every passage against every item by the plain BM25 formula."""
    rnd = random.Random(2)
    rows = items(rnd, 60)
    index, df, total = index_of(rows)
    passages = [decontaminate.item_words(" ".join(rnd.sample(rows[rnd.randrange(60)][1].split(), 5) + sentence(rnd, 20).split()
                                                  + rows[rnd.randrange(60)][1].split()[:rnd.randint(0, 30)]).encode()) for _ in range(80)]
    want = set()
    for item, (_, text) in enumerate(rows):
        h = decontaminate.item_words(text.encode())
        t, tf = np.unique(h, return_counts=True)
        w = np.array([math.log1p((60 - df[int(x.view(np.int64))] + 0.5) / (df[int(x.view(np.int64))] + 0.5)) for x in t])
        w *= tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(h) / (total / 60)))
        for p, have in enumerate(passages):
            if w[np.isin(t, have)].sum() / w.sum() >= 0.4:
                want.add((p, item))
    number = np.repeat(np.arange(80), [len(p) for p in passages])
    got = index.search(number, np.concatenate(passages), 80, 0.4)
    assert want and set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_finds_planted_items_and_leaves_others(spark):
    rnd = random.Random(8)
    bench = items(rnd, 40)
    rows = [(i, " ".join(sentence(rnd, 10) for _ in range(60))) for i in range(30)]
    planted = {}
    for i in range(0, 30, 3):
        w = rows[i][1].split()
        at = rnd.randrange(len(w))
        item = bench[i]
        rows[i] = (i, " ".join(w[:at]) + " " + item[1].replace(" ", "\n", 1).upper().lower() + " " + " ".join(w[at:]))
        planted[i] = item[0]
    # Only a question, or only a third of an item, is no leak.
    rows.append((90, " ".join(bench[1][1].split()[:max(3, len(bench[1][1].split()) // 3)])))
    table = spark.createDataFrame([*bench, (None, "x"), (77, None), (78, ""), (79, "a b")], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [*rows, *awkward_texts()]), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(planted.items())
    left = decontaminate.drop_contaminated(docs(spark, rows), table)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - set(planted) and left.columns == docs(spark, rows[:1]).columns


def test_slices_give_the_same(spark, monkeypatch):
    rnd = random.Random(9)
    bench = items(rnd, 25)
    rows = [(i, sentence(rnd, 40) + " " + bench[i][1] + " " + sentence(rnd, 30)) for i in range(20)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    whole = {tuple(r)[:4] for r in decontaminate.find_leaks(docs(spark, rows), table).collect()}
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 9)
    assert {tuple(r)[:4] for r in decontaminate.find_leaks(docs(spark, rows), table).collect()} == whole and len(whole) == 20


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six.")], "item_id long, text string")
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, awkward_texts()), bench.limit(0)).count() == 0


def test_word_spans_do_not_cross_rows():
    data, offsets = np.frombuffer(b"ab cdef g", np.uint8), np.array([0, 4, 4, 9])
    start, end, row = words.spans(data, offsets, words.SPACED)
    assert [(bytes(data[a:b]), int(r)) for a, b, r in zip(start, end, row, strict=True)] == [(b"ab", 0), (b"c", 0), (b"def", 2), (b"g", 2)]


def test_copies_in_another_case_are_found_in_any_script(spark):
    """Whole items in upper case with accented, Greek and Cyrillic letters, and in decomposed form, are leaks."""
    import unicodedata

    bench = [(1, "À quelle époque l'été précède-t-il la récolte des pêches près du château délabré? Après la fête de l'école."),
             (2, "Ποιος έγραψε τους νόμους της πόλεως πριν από τον πόλεμο; Ο Σόλων έγραψε όλους τους παλαιούς νόμους."),
             (3, "Какой город стоял у широкой реки до большого пожара? Старый город стоял у широкой реки."),
             (4, "Welche Straße führt größtenteils über die Brücke außerhalb der Stadt? Die große Straße führt über die Brücke.")]
    rnd = random.Random(5)
    rows = []
    for i, t in bench:
        rows += [(i, sentence(rnd, 20) + " " + t.upper() + " " + sentence(rnd, 20)),
                 (10 + i, sentence(rnd, 90) + "\n" + unicodedata.normalize("NFD", t.title()) + "\n" + sentence(rnd, 9))]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [*rows, (50, "ASCII only"), (51, sentence(rnd, 40).upper())]), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 10) for i, _ in rows}
    assert decontaminate.folded_text(b"A\xffB\xc3\x89") == b"a\xffb\xc3\xa9"


def test_one_item_decides_nothing_about_another(spark):
    """A question and, 900 words on, its answer is no leak, with or without an unrelated item of 2,000 words."""
    rnd = random.Random(12)
    item, long = items(rnd, 1)[0], sentence(rnd, 2000)
    q, a = "which wide river runs past the seven old stone mills of that town?", "the slow green river beside the northern hills runs past them"
    rows = [(1, sentence(rnd, 50) + " " + q + " " + sentence(rnd, 900) + " " + a + " " + sentence(rnd, 50)),
            (2, sentence(rnd, 700) + " " + q + " " + a + " " + sentence(rnd, 700)), (3, sentence(rnd, 300) + " " + long)]
    for extra in ([], [(9, long)], [(9, long), item]):
        table = spark.createDataFrame([(7, q + " " + a), *[(i + 20, t) for i, t in extra]], "item_id long, text string")
        got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(docs(spark, rows), table).collect()}
        assert {x[:2] for x in got} == {(2, 7)} | ({(3, 29)} if extra else set())


def test_window_shares_against_brute_force():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        have = rnd.integers(0, 9, rnd.integers(1, 40)).astype(np.uint64)
        want = np.unique(rnd.integers(0, 12, rnd.integers(1, 8)).astype(np.uint64))
        weight, span = rnd.random(len(want)), int(rnd.integers(1, 15))
        got = decontaminate._window_shares(have, want, weight, len(have), span)
        assert np.allclose(got, [weight[np.isin(want, have[s:s + span])].sum() for s in range(len(have))])


def test_columns_of_any_name_stay(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten.")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "one two three four five six seven eight nine ten.", 5, "a", 3), (2, "clean", 6, "b", 4)],
                                 "doc_id long, text string, _row int, _leak_id string, leak_id int")
    left = decontaminate.drop_contaminated(rows, bench)
    assert left.columns == rows.columns and [tuple(r) for r in left.collect()] == [(2, "clean", 6, "b", 4)]
