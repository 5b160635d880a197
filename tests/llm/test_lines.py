from __future__ import annotations

from touchline.llm import line_dedup
from tests.llm.fixtures import awkward_texts, docs, empty


def brute(rows, window):
    """Texts after cutting every unit of a window that occurred before, in (null last, id, text hash, unit) order."""
    first = {}
    listed = []
    for i, t in rows:
        body = (t or "").encode()
        u = [body[a:b].strip() for a, b in line_dedup.units(body)]
        for s in range(len(u) - window + 1):
            listed.append((tuple(u[s:s + window]), (i is None, i or 0), body, s))
    return first, listed


def test_later_runs_go_and_first_ones_stay(spark):
    rows, window = awkward_texts(), 3
    _, listed = brute(rows, window)
    got = line_dedup.dedup_lines(docs(spark, rows), window).select("doc_id", "text", "n_units_cut").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    owner = {}
    for w, order, body, s in listed:
        owner.setdefault(w, []).append((order, body, s))
    texts = {}
    for r in got:
        texts.setdefault(str(r.doc_id), []).append(r.text)
    for i, t in rows:
        body = (t or "").encode()
        spans = line_dedup.units(body)
        u = [body[a:b].strip() for a, b in spans]
        order = (i is None, i or 0)
        # A window is cut if an equal one stands in an earlier id, or earlier in the same text.
        earlier = [s for s in range(len(u) - window + 1)
                   if any(o < order or (o == order and b == body and x < s) for o, b, x in owner[tuple(u[s:s + window])])]
        others = [s for s in range(len(u) - window + 1) if any(o == order and b != body for o, b, _ in owner[tuple(u[s:s + window])])]
        if not others:  # texts under one id are ordered by their hash, which is checked elsewhere
            want = t if not earlier else line_dedup.cut_units(body, earlier, window).decode()
            assert want in texts[str(i)]


def test_first_text_is_never_changed_and_all_later_copies_are_empty(spark):
    text = "One line here.\nAnother line there.\nThird line.\nFourth one."
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [(5, text), (2, text), (9, "Before.\n" + text + "\nAfter.")])).collect()}
    assert got == {2: text, 5: "", 9: "Before.\nAfter."}


def test_winnowing_guarantee():
    import numpy as np

    rnd = np.random.default_rng(3)
    for w in (2, 3, 5):
        a, b = rnd.integers(0, 1 << 60, 40, dtype=np.uint64), rnd.integers(0, 1 << 60, 40, dtype=np.uint64)
        b[10:10 + w] = a[20:20 + w]
        prints = [set(h[line_dedup.winnow(h, w)[0]].tolist()) for h in (a, b)]
        assert prints[0] & prints[1]


def test_short_null_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "One.\nTwo."), (4, "One.\nTwo."), (5, "Same.\nSame.\nSame.\nSame.\nSame.")]
    got = {r.doc_id: (r.text, r.n_units_cut) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[4] == ("One.\nTwo.", 0)
    assert got[5][1] == 4
    out = line_dedup.dedup_lines(empty(spark))
    assert out.count() == 0 and out.columns[:-1] == empty(spark).columns


def brute_words(rows, run):
    """Per row, the words of windows of ``run`` words that occurred before, in (null last, id, text hash, word) order."""
    first = {}
    gone = {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        w = (t or "").encode().split()
        for s in range(len(w) - run + 1):
            if tuple(w[s:s + run]) in first:
                gone.setdefault(i, set()).update(range(s, s + run))
            first.setdefault(tuple(w[s:s + run]), i)
    return gone


def test_word_runs_go_to_their_exact_ends(spark):
    """Passages of one or two sentences, without a sentence end, and begun in mid-sentence."""
    import random

    from tests.llm.fixtures import sentence

    rnd = random.Random(21)
    other = iter(range(10**6))
    foreign = lambda n: " ".join(f"w{next(other)}" for _ in range(n))
    passages = [sentence(rnd, 60), sentence(rnd, 30) + " " + sentence(rnd, 30), sentence(rnd, 80)[:-1], sentence(rnd, 50)[:-1]]
    rows = [(i, foreign(30) + " " + p + " " + foreign(20)) for i, p in enumerate(passages)]
    rows += [(10 + i, foreign(9) + "\n" + foreign(3) + " " + p.replace(" ", "\n", 2) + " " + foreign(7)) for i, p in enumerate(passages)]
    rows += [(20, foreign(5) + " " + passages[0].split(" ", 5)[5] + " " + passages[2] + " " + foreign(5)), (30, sentence(rnd, 49)), (31, rows[0][1]),
             (None, foreign(1) + " " + passages[3]), (32, sentence(rnd, 49) * 2), (33, "ab " * 200)]
    rows += [(34, foreign(2) + " " + rows[-3][1].split()[1] + " " + foreign(2)), (35, None), (36, "")]
    gone = brute_words(rows, 50)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows), 3, words=50).collect()}
    assert len(got) == len(rows) and len(gone) >= 8
    for i, t in rows:
        want = [w for n, w in enumerate((t or "").split()) if n not in gone.get(i, ())]
        assert (got[i].text or "").split() == want, i
        assert (got[i].n_units_cut > 0) == (i in gone)
    assert got[31].text == "" and got[35].text is None and got[30].text == dict(rows)[30]


def test_unit_cuts_are_the_same_by_both_ways():
    body = b"One a.  Two b. Three c.\nFour d.\n\n Five e. Six f.\nSeven g"
    for starts in ([], [0], [1], [2, 3], [0, 3], [4], [0, 1, 2, 3, 4]):
        n = len(set().union(*(range(x, x + 3) for x in starts)))
        assert line_dedup.cut_runs(body, starts, 3, []) == (line_dedup.cut_units(body, starts, 3), n)


def test_unit_spans_of_whole_batches_are_the_units():
    import random

    import numpy as np

    from touchline.llm import words

    rnd = random.Random(1)
    for _ in range(500):
        texts = [bytes(rnd.choice(b"ab.!? \t\r\n\x0b\x0c\xc3\xa9") for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 4))]
        data = np.frombuffer(b"".join(texts), np.uint8)
        spans = words.spans(data, np.cumsum([0, *map(len, texts)]), words.SPACED)
        got = [(int(r), bytes(data[a:b])) for a, b, r in zip(*line_dedup.unit_spans(data, *spans), strict=True)]
        assert got == [(i, t[a:b].strip()) for i, t in enumerate(texts) for a, b in line_dedup.units(t)]


def test_groups_of_windows_are_judged_by_place():
    import numpy as np

    # (fingerprint, windows, text, first window) and the ids' ranks; the first two are one place
    e = np.array([(8, 1, 5, 2, 1), (8, 1, 5, 2, 1), (8, 1, 4, 9, 1), (8, 2, 0, 0, 1), (6, 1, 0, 0, 1), (8, 1, 0, 0, 1), (8, 2, 0, 3, 1)], line_dedup.ENTRY)
    lead, later, mixed = line_dedup.judge(e, np.array([1, 1, 1, 7, 7, 9, 7]))
    assert later.tolist() == [True, True, False, False, False, True, True]
    assert lead.tolist() == [False, False, True, True, True, False, False]
    assert mixed.tolist() == [False, False, True, True, False, False, False]
    twins = line_dedup.judge(e[:2], np.array([1, 1]))
    assert twins[0].sum() == 1 and not twins[1].any()


def test_copies_of_one_passage_do_not_meet_in_one_bucket():
    import numpy as np
    import pyarrow as pa

    n = 4096
    e = np.zeros(n, line_dedup.ENTRY)
    e["print"], e["whole"], e["n"] = 12, 3, 2
    e["hash"] = np.random.default_rng(1).integers(-2**63, 2**63 - 1, n)
    out = line_dedup._packed(e, pa.array(np.arange(n)), 6)
    held = {b: np.frombuffer(x, line_dedup.ENTRY) for b, x in zip(out.column("bucket").to_pylist(), out.column("entries").to_pylist(), strict=True)}
    assert sum(map(len, held.values())) == n and max(map(len, held.values())) < 3 * n / 64
    assert sum(int((x["n"] > 0).sum()) for x in held.values()) == 1


def test_runs_across_buckets_ids_and_null_ids(spark):
    """Passages that begin and end differently, by texts of equal and of null ids, under a string id too."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(7)
    common = [f"c{i}" for i in range(400)]
    rows = []
    for i in range(60):
        a, n = rnd.randint(0, 340), rnd.randint(20, 300)
        rows.append((None if i == 31 else 100 + i, " ".join([f"x{i}", *common[a:a + n], f"y{i}"])))
    gone = brute_words(rows, 50)
    for frame in (docs(spark, rows), docs(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string"))):
        got = {None if r.doc_id is None else int(r.doc_id): r for r in line_dedup.dedup_lines(frame.repartition(7), 3, words=50).collect()}
        for i, t in rows:
            assert got[i].text.split() == [w for k, w in enumerate(t.split()) if k not in gone.get(i, ())], i
