from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def few_partitions(spark: SparkSession):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def documents(spark: SparkSession):
    """Rows (doc_id, text) -> a documents table with columns whose names clash with those the operators use inside."""

    def make(rows: list[tuple]):
        full = [(d, t, "en", None, len(t or ""), "x", 7, "y") for d, t in rows]
        return spark.createDataFrame(full, DOCS + ", n_words string, kept int, row string").repartition(3)

    return make


def corpus(seed: int, n: int = 40) -> list[tuple]:
    """Small texts from few words, with copies, near copies, shared passages and lines, nulls and empty texts."""
    rng = random.Random(seed)
    vocabulary = ["ab", "Cé", "the", "of", "wörd", "x,", "Y.", "longer", "日本", "A"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(24))
    line = "a line that many of the documents hold, as they do"
    rows: list[tuple] = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.35 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + " " + passage + rng.choice([" ", "\t", "\n"]) + text[at:]
        if text and rng.random() < 0.4:
            text = rng.choice(["", "  "]) + rng.choice([line, line.upper(), line + "é"]) + "\x0b\n" + text
        rows.append((d, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, rows[3][1]), (None, passage), (5, rows[5][1]), (n + 3, passage * 40)]
    rng.shuffle(rows)
    return rows
