from __future__ import annotations

import math
import random

import numpy as np

from touchline.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, q int, codes string, error string, `entry` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", "y", 2) for i, v, lab in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale):
    """Plain Lloyd rounds with full scans, in Python integers."""
    ok = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(ok[0][1]) if ok else 0
    cuts = [dim * p // parts for p in range(parts + 1)]
    seeds = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[s[1][a:b] for s in seeds] for a, b in zip(cuts, cuts[1:], strict=False)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(q[a:b], e, strict=True)), j) for j, e in enumerate(book))
                 for a, b, book in zip(cuts, cuts[1:], books, strict=False)] for _, q, _ in ok]

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [q[cuts[p]:cuts[p + 1]] for (_, q, _), b in zip(ok, best, strict=True) if b[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    best = assign()
    return sorted(((i, lab, [j for _, j in b], sum(d for d, _ in b)) for (i, _, lab), b in zip(ok, best, strict=True)), key=str), books


def vectors(seed=5, n=150, dim=10):
    rnd = random.Random(seed)
    grid = lambda: rnd.randint(-60, 60) / 64  # noqa: E731  exact in single precision, many ties
    rows = [(i * 3, [grid() for _ in range(dim)], None if i % 7 == 0 else i % 4) for i in range(n)]
    # Copies under other ids, a repeated row, equal ids of different vectors, a null id.
    rows += [(1000 + i, rows[5][1], 9) for i in range(60)] + [rows[8], rows[8], (9, rows[20][1], 1), (None, rows[3][1], None)]
    return rows


def awkward(dim=10):
    bad = [(5000, None, 1), (5001, [], 1), (5002, [None] * dim, 1), (5003, [float("nan")] * dim, 2), (5004, [float("inf")] * dim, 2)]
    return bad + [(5005, [1.0, 2.0], 1), (5006, [3e30] * dim, 1)]


def test_matches_full_scans(spark):
    for entries, rounds in ((16, 4), (256, 2), (3, 0)):
        rows = vectors()
        made = codebooks.compress(table(spark, rows + awkward()), 4, entries, rounds)
        want, books = brute(rows, 4, entries, rounds, 1024)
        assert sorted(((r["vec_id"], r["label"], r["codes"], r["error"]) for r in made.rows.collect()), key=str) == want
        assert [b.tolist() for b in made.codebooks] == books
        by_label = {}
        for _, lab, _, e in want:
            by_label[lab] = by_label.get(lab, 0) + e
        assert {(r["label"], r["label_error"]) for r in codebooks.with_label_error(made.rows).collect()} == set(by_label.items())


def test_partitions_and_sides_do_not_matter(spark, monkeypatch):
    rows = vectors(6)
    one = codebooks.compress(table(spark, rows).repartition(1), 4, 12, 3)
    monkeypatch.setattr(codebooks, "CHUNK", 7)
    many = codebooks.compress(table(spark, rows).repartition(9), 4, 12, 3)
    assert codebooks.listing(one.codebooks) == codebooks.listing(many.codebooks)
    assert sorted(map(str, one.rows.collect())) == sorted(map(str, many.rows.collect()))


def test_active_entries_equal_a_full_scan():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, old = rng.integers(-3, 4, (80, 2)), rng.integers(-3, 4, (9, 2))
        code, dist = codebooks.nearest(x, old)
        moved = rng.random(9) < 0.4
        new = np.where(moved[:, None], rng.integers(-3, 4, (9, 2)), old)
        got = codebooks.active_nearest(x, code, dist, new, (new != old).any(axis=1))
        want = codebooks.nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_large_components_stay_exact():
    x = np.array([[(1 << 28) - 1, -(1 << 28)], [5, 7]])
    code, dist = codebooks.nearest(x, np.array([[-(1 << 28), (1 << 28) - 1], [5, 8]]))
    assert code.tolist() == [1, 1] and dist.tolist() == [((1 << 28) - 6) ** 2 + ((1 << 28) + 8) ** 2, 1]


def test_empty_and_useless_tables(spark):
    for rows in ([], awkward()[:5]):
        made = codebooks.compress(table(spark, rows))
        assert made.rows.count() == 0 and codebooks.listing(made.codebooks) == "" and codebooks.with_label_error(made.rows).count() == 0
    made = codebooks.compress(table(spark, [(7, [0.5, 0.25, 1.0], None)]))
    assert [(r["codes"], r["error"]) for r in made.rows.collect()] == [([0, 0, 0, 0], 0)]
