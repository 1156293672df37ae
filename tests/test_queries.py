"""Every registered query against its SQL, and queries whose results must not depend on partitioning."""

import pytest

import __spark_entry__ as entry
import check
from registry import views
from registry.oracle import ORACLE
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


#: Byte-pair merges and random projections have no SQL form; these have tests of their own below.
WITHOUT_SQL = {"token_vocabulary", "vector_knn_recall"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_token_vocabulary_equals_the_plain_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(views.vocabulary_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tok for r in QUERIES["token_vocabulary"](spark, SF).collect()}
    assert got == {d: len(plain.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_recall_of_approximate_neighbours(spark):
    rows = QUERIES["vector_knn_recall"](spark, SF).collect()
    assert len(rows) == 25 and all(r.n_exact == 20 for r in rows) and sum(r.n_found for r in rows) >= 0.9 * 20 * len(rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    same, note = check.compare(spark, con, name, SF)
    assert same, note


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "pos", "doc_id", "title", "score"] and rows.count() > 0


@pytest.mark.parametrize("name", ["chunks", "context", "fused_scores", "running_usage"])
def test_results_do_not_depend_on_partitions(spark, name):
    results = []
    for partitions in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            results.append(sorted(map(str, entry.queries()[name](spark, SF).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1]


def test_context_is_not_cut_short(spark, tmp_path):
    """Documents of a few hundred words are in the context with the words that are read of them, not with the first hundred of all."""
    texts = [(d, "\n".join(" ".join(f"w{d % 7}x{line}y{i}" for i in range(10)) for line in range(40)), "en", "web", 0) for d in range(24)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(q, f"w{q}x0y0 w{q}x1y1. w{q}x2y2") for q in range(3)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = QUERIES["context"](spark, str(tmp_path)).collect()
    assert sorted(r.qid for r in rows) == [0, 1, 2] and min(len(r.context.split()) for r in rows) > 500
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["context_full"](spark, str(tmp_path)).collect()))
