"""Small tables with the awkward rows every operator must take, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, body string, fp long, block long, shard int, "
          "score double, label int, starts string, `key` string, `part` int, `row` string")


def sentence(rnd: random.Random, words: int) -> str:
    return " ".join("".join(rnd.choice(["ta", "re", "mi", "so", "lu", "ké", "don", "x"]) for _ in range(rnd.randint(1, 4)))
                    for _ in range(words)) + "."


def awkward_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Exact and near copies, shared passages, repeated rows, nulls, empty, periodic and very long texts."""
    rnd = random.Random(seed)
    passage = " ".join(sentence(rnd, 9) for _ in range(7))
    plain = ["\n".join(" ".join(sentence(rnd, 8) for _ in range(4)) for _ in range(3)) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(plain)]
    rows += [(20, plain[3]), (21, plain[3]), (22, plain[4].replace("ta", "TA", 1)), (23, plain[5] + " tail")]
    rows += [(30, plain[0][:80] + " " + passage + " " + plain[1][:60]), (31, plain[2][:50] + "\n" + passage + "\nend"), (32, passage)]
    rows += [(40, None), (41, ""), (42, "   \n\t "), (43, "word"), (44, "Word"), (45, "two words")]
    rows += [(50, "This " * 900), (51, "Thus This " * 30 + "This " * 400), (52, "a" * 3000), (53, "a" * 2999 + "é" * 40)]
    rows += [(60, plain[6]), (60, plain[6]), (60, plain[7]), (None, plain[8]), (None, None)]
    rows += [(70, " ".join(sentence(rnd, 12) for _ in range(800)) + passage)]
    return rows


def docs(spark, rows):
    """A documents table with further columns whose names the operators use themselves."""
    full = [(i, t, "en", None if (i or 0) % 7 == 3 else f"src{(i or 0) % 3}", None if t is None else len(t), "x", 1, 2, 3, 0.5, 1, "y", "z", 4, "r")
            for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
