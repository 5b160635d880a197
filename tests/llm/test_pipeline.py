from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from touchline.llm import decontaminate, line_dedup
from tests.llm.fixtures import awkward_texts, docs, sentence
from tests.llm.test_lines import brute_words
from tests.llm.test_simhash import fingerprint, groups

SF = "/root/testdata/sf0.001"


def test_stages_are_the_five_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "packing"] and cp.ORACLE_SQL is None


def test_simhash_stage_keeps_one_of_each_group(spark):
    rows = awkward_texts()
    kept = cp.near_copy_stage(spark, docs(spark, rows), SF).collect()
    root = groups([fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            g = root[fingerprint(t)]
            least[g] = min(least.get(g, i), i)
    # An id none of whose rows is the first of its group is gone.
    copies = {i for i, t in rows if least.get(root[fingerprint(t)]) != i}
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(i) for i, _ in rows if i not in copies})


def test_line_stage_keeps_rows_and_updates_length(spark):
    rows = awkward_texts()
    d = docs(spark, rows)
    out = cp.line_stage(spark, d, SF)
    got = out.collect()
    assert out.columns == d.columns and len(got) == len(rows)
    assert all((r.text is None and r.n_chars is None) or r.n_chars == len(r.text) for r in got)


def test_line_stage_cuts_passages_begun_in_mid_sentence(spark):
    """One sentence of 60 words, met again in the middle of others and over line ends."""
    rnd = random.Random(8)
    passage = sentence(rnd, 60)
    other = [sentence(rnd, 25) for _ in range(8)]
    rows = [(1, f"{other[0]} {passage} {other[1]}"), (2, f"{other[2][:-1]} {passage[:-1]} {other[3]}"), (3, f"{other[4]} " + passage.replace(" ", "\n", 30) + f" {other[5]}")]
    got = {r.doc_id: r for r in cp.line_stage(spark, docs(spark, rows), SF).collect()}
    assert got[1].text == rows[0][1]
    assert all(not set(passage.split()[:-1]) <= set(got[i].text.split()) and got[i].n_chars == len(got[i].text) for i in (2, 3))


def test_whole_pipeline_against_its_parts(spark):
    """Quality and packing through Spark; the stages between by brute force on the driver's small table."""
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    good = cp.quality_stage(spark, raw, SF)
    assert good.columns == raw.columns
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    first, cut = {}, {}
    for i, t in rows:
        body = t.encode()
        u = [body[a:b].strip() for a, b in line_dedup.units(body)]
        gone = []
        for s in range(len(u) - 2):
            w = tuple(u[s:s + 3])
            if w in first:
                gone.append(s)
            else:
                first[w] = (i, s)
        cut[i] = gone
    words = brute_words(rows, line_dedup.RUN)
    for i, t in rows:
        left = line_dedup.cut_runs(t.encode(), cut[i], 3, [(n, 1) for n in sorted(words.get(i, ()))])[0].decode()
        cut[i] = left if cut[i] or i in words else t
    fps = {i: fingerprint(t) for i, t in cut.items()}
    root = groups(fps.values())
    least = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " " + " ".join(decontaminate.re.findall(r"\w+", t.lower())) + " "
    want = {i for i in least.values() if not any(plain(b) in plain(cut[i]) for _, b in bench)}
    got = cp.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want
    assert sum(r["size"] for r in got) == sum(len(cut[i].encode()) + 1 for i in want)


def test_toxic_or_not_clean_text_stays(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(" ".join(sentence(rnd, 9) for _ in range(4)) for _ in range(3))) for i in range(20)]
    d = docs(spark, rows)
    assert cp.line_stage(spark, d, SF).select("doc_id", "text").exceptAll(d.select("doc_id", "text")).count() == 0
    assert cp.near_copy_stage(spark, d, SF).count() == 20 and cp.leak_stage(spark, d, SF).count() == 20


def test_rows_are_decided_each_for_its_own_text(spark):
    """Rows of a repeated id or without id: a copy or a leak takes only itself along."""
    rnd = random.Random(11)
    t = ["\n".join(" ".join(sentence(rnd, 9) for _ in range(4)) for _ in range(3)) for _ in range(9)]
    rows = [(1, t[0]), (2, t[0]), (2, t[1]), (3, t[2]), (3, t[3]), (3, t[3]),
            (None, t[4]), (None, t[4]), (None, t[5]), (None, t[0]), (4, t[6]), (None, t[6]), (None, None), (None, "")]
    kept = cp.near_copy_stage(spark, docs(spark, rows), SF).collect()
    want = [(1, t[0]), (2, t[1]), (3, t[2]), (3, t[3]), (4, t[6]), (None, t[4]), (None, t[5])]
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.text) == sorted(map(str, want))
    assert sum(not r.text for r in kept) == 1
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first().text
    rows = [(5, t[7]), (5, t[8] + " " + item), (None, t[0] + " " + item), (None, t[1]), (None, None)]
    left = cp.leak_stage(spark, docs(spark, rows), SF)
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str(x) for x in (rows[0], rows[3], rows[4]))
    assert left.columns == docs(spark, rows).columns


def test_quality_rejects_only_the_row_of_a_bad_text(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    good = cp.quality_stage(spark, raw, SF)
    clean = good.orderBy("doc_id").limit(5).collect()
    bad = raw.join(good.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(2).collect()
    assert len(bad) == 2
    rows = [(None, r.text) for r in [*clean, *bad]] + [(-7, clean[0].text), (-7, bad[0].text)]
    again = spark.createDataFrame([{**raw.first().asDict(), "doc_id": i, "text": x} for i, x in rows], raw.schema)
    kept = cp.quality_stage(spark, raw.unionByName(again), SF).where("doc_id is null or doc_id = -7").collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str((i, x)) for i, x in rows if x not in {b.text for b in bad})


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    assert cp.quality_stage(spark, raw, str(tmp_path)).count() == cp.leak_stage(spark, raw, str(tmp_path)).count() == raw.count()


def test_columns_of_any_name_stay(spark):
    names = ("_row", "_id", "_hash", "text_hash", "_text_hash", "_new", "_cut_id", "_cut_hash", "_cut_new", "_rejected", "rejected", "leak_id", "listed_id", "copy", "row")
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    wide = raw.select("*", *[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names])
    for _, stage in cp.STAGES[:-1]:
        got, plain = stage(spark, wide, SF), stage(spark, raw, SF)
        assert got.columns == wide.columns
        assert got.where(" or ".join(f"`{n}` <> concat('{n}-', doc_id)" for n in names)).count() == 0
        assert got.select(raw.columns).exceptAll(plain).count() == 0 and got.count() == plain.count()
