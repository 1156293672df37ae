import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.operators.context import ANSWER_INSTRUCTIONS, assemble_context, build_prompt, number_context
from folioscope.operators.joins import join_chosen
from folioscope.operators.ranking import fuse, order_shortlist, query_report, shortlist, shortlist_report
from folioscope.operators.snippets import chunks_of, knn_within, reassemble, token_budget, with_texts
from folioscope.operators.usage import running_usage, usage_by
from folioscope.plans.answer import AnswerConfig, context_of, retrieve_snippets, shortlist_docs
from folioscope.sources.chunks import part_of, write_chunks

HITS = [("q", 0, 1, "A", "a"), ("q", 0, 2, "B", "b"), ("q", 0, 3, "C", "c"), ("q", 1, 1, "B", "b"), ("q", 1, 2, "D", "d")]


@pytest.fixture(scope="module")
def fused(spark):
    return fuse(spark.createDataFrame(HITS, "qid string, qpos int, rank int, id string, title string"), attrs=["title"]).cache()


def test_fusion_and_cut(fused):
    rows = {r.id: r.score for r in fused.collect()}
    assert rows == {"B": 1.5, "A": 1.0, "D": 0.5, "C": 1 / 3}
    assert [(r.pos, r.id) for r in shortlist(fused, 0.8).orderBy("pos").collect()] == [(1, "B"), (2, "A")]
    assert [r.id for r in shortlist(fused, 1.0).orderBy("pos").collect()] == ["B", "A", "D", "C"]
    assert [r.id for r in shortlist(fused, 0.0).collect()] == ["B"]


def test_ties_keep_first_seen_order(spark):
    hits = [("q", 0, 1, "Z"), ("q", 1, 1, "A"), ("q", 0, 2, "M"), ("q", 1, 2, "B")]
    ordered = order_shortlist(fuse(spark.createDataFrame(hits, "qid string, qpos int, rank int, id string")))
    assert [r.id for r in ordered.orderBy("pos").collect()] == ["Z", "A", "M", "B"]


def test_reports(spark, fused):
    assert shortlist_report(shortlist(fused)).first().report == "Considering the following 2 relevant documents.\n1.50 \t b\n1.00 \t a\n"
    queries = spark.createDataFrame([("q", 1, " b"), ("q", 0, "a"), ("q", 2, "")], "qid string, qpos int, query string")
    assert query_report(queries).first().queries == "a; b;"


@pytest.mark.parametrize("sizes,kept", [([4, 6, 3], 2), ([4, 7, 1], 1), ([11, 1], 0), ([0, 10, 0, 1], 3)])
def test_token_budget(spark, sizes, kept):
    rows = [("q", float(i), 1, 1, n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "qid string, distance double, pos int, rank int, n_tokens bigint")
    assert sorted(r.distance for r in token_budget(df, 10).collect()) == [float(i) for i in range(kept)]


def test_context_keeps_gaps(spark):
    short = spark.createDataFrame([("q", 1, "x", "X"), ("q", 2, "y", "Y"), ("q", 3, "z", None), ("p", 1, "x", "X")], "qid string, pos int, doc_id string, title string")
    snips = spark.createDataFrame([("q", "x", 10, "late"), ("q", "x", 2, "early"), ("q", "z", 1, "zed")], "qid string, doc_id string, chunk_id int, document string")
    texts = reassemble(snips)
    assert sorted((r.number, r.text) for r in number_context(short, texts).collect()) == [(1, "early late"), (3, "zed")]
    contexts = {r.qid: r.context for r in assemble_context(short, texts).collect()}
    assert contexts == {"p": "", "q": "======\n document 1\n title X\n early late\n\n======\n document 3\n title None\n zed\n"}
    questions = spark.createDataFrame([("q", "why?")], "qid string, question string")
    messages = build_prompt(assemble_context(short, texts), questions).first().messages
    assert [(m.role, m.content) for m in messages] == [("system", contexts["q"]), ("system", ANSWER_INSTRUCTIONS), ("user", "why?")]


def test_join_chosen_forms_agree(spark):
    large = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k")).cache()
    chosen = spark.createDataFrame([(0, "a"), (7, "b"), (99, "c")], "k bigint, v string")
    for how in ("inner", "left_semi", "left_anti", "left"):
        forms = [join_chosen(large, chosen, "k", how, ["id"], **b) for b in ({}, {"max_rows": 1}, {"max_rows": 1, "hot_rows": 100})]
        first, *others = [sorted(map(str, f.collect())) for f in forms]
        assert first and all(o == first for o in others)


def test_knn_within_forms_agree(spark):
    rng = random.Random(1)
    chunks = [(f"{d}_{c}", d, c, [rng.random() for _ in range(4)]) for d in range(6) for c in range(1, 9)]
    index = spark.createDataFrame(chunks, "id string, doc_id int, chunk_id int, embedding array<float>")
    short = spark.createDataFrame([(q, d) for q in range(3) for d in range(q, q + 3)], "qid int, doc_id int")
    asked = spark.createDataFrame([(q, [rng.random() for _ in range(4)]) for q in range(3)], "qid int, qvec array<float>")
    first, second = ([(r.qid, r.doc_id, r["rank"], r.id, r.distance) for r in knn_within(index, asked, short, 3, **b).orderBy("qid", "doc_id", "rank").collect()]
                     for b in ({}, {"max_rows": 1, "hot_rows": 2}))
    assert first == second and len(first) == 27
    vectors = {c[0]: c[3] for c in chunks}
    query = {r.qid: r.qvec for r in asked.collect()}
    for qid, doc, rank, cid, distance in first:
        order = sorted((sum((a - b) ** 2 for a, b in zip(vectors[f"{doc}_{c}"], query[qid])), f"{doc}_{c}") for c in range(1, 9))
        assert order[rank - 1][1] == cid and abs(order[rank - 1][0] - distance) < 1e-6


def test_usage(spark):
    calls = [("m", i, 1, 2, 10) for i in range(50)] + [("n", 0, None, 5, 1), ("n", 1, 3, None, 1)]
    df = spark.createDataFrame(calls, "model string, at int, completion_tokens bigint, prompt_tokens bigint, us bigint")
    assert {r.model: (r.completion_tokens, r.prompt_tokens, r.total_tokens, r.us) for r in usage_by(df, ["model"], "us").collect()} == {
        "m": (50, 100, 150, 500), "n": (3, 5, 8, 2)}
    running = {(r.model, r.at): (r.completion_tokens, r.prompt_tokens, r.total_tokens) for r in running_usage(df, ["model"], ["at", "model"], "us").collect()}
    assert all(running["m", i] == (i + 1, 2 * i + 2, 3 * i + 3) for i in range(50))
    assert running["n", 0] == (None, 5, 5) and running["n", 1] == (3, 5, 8)


def test_usage_of_intervals(spark):
    df = spark.sql("SELECT 1 AS completion_tokens, 2 AS prompt_tokens, INTERVAL '1.5' SECOND AS response_time FROM range(2)")
    assert usage_by(df, []).first().response_time.total_seconds() == 3.0


def chunk_rows_of(spark, n_docs=40, per_doc=3):
    rows = [(f"{d}_{c}", d, c, f"text {d} {c} " + "word " * c, c + 3, [float(d % 7), float(c)]) for d in range(n_docs) for c in range(1, per_doc + 1)]
    return spark.createDataFrame(rows, "id string, doc_id bigint, chunk_id int, document string, n_tokens bigint, embedding array<float>")


@pytest.fixture
def laid_out(spark, tmp_path):
    path = str(tmp_path / "chunks")
    write_chunks(chunk_rows_of(spark), path, parts=8)
    return path


def test_a_lookup_reads_the_partitions_of_its_documents_only(spark, laid_out):
    wanted = spark.createDataFrame([("q", 1, 5, "t"), ("p", 1, 5, "t"), ("p", 2, 11, None)], "qid string, pos int, doc_id bigint, title string")
    asked = spark.createDataFrame([("q", [1.0, 1.0]), ("p", [5.0, 2.0])], "qid string, qvec array<float>")
    want = sorted(map(tuple, knn_within(chunk_rows_of(spark).drop("document"), asked, wanted, 2).select("qid", "doc_id", "rank", "id", "distance").collect()))
    needed = {r.p for r in spark.createDataFrame([(5,), (11,)], "doc_id bigint").select(part_of(F.col("doc_id"), 8).alias("p")).collect()}
    schema = spark.read.parquet(laid_out).schema
    others = [f for d in Path(laid_out).glob("part_8=*") if int(d.name.split("=")[1]) not in needed for f in d.glob("*.parquet")]
    assert others
    for f in others:
        f.write_bytes(b"nobody reads this")
    index = spark.read.schema(schema).parquet(laid_out)
    near = knn_within(index.drop("document"), asked, wanted, 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[part_8#\d+ IN \(", plan)
    assert sorted(map(tuple, near.select("qid", "doc_id", "rank", "id", "distance").collect())) == want
    kept = near.select("qid", "doc_id", "id", "chunk_id")
    texts = {(r.qid, r.id): r.document for r in with_texts(kept, index).collect()}
    assert texts == {(q, i): next(r.document for r in chunk_rows_of(spark).collect() if r.id == i) for q, _, _, i, _ in want}


def test_documents_beyond_a_broadcast_are_found_too(spark, laid_out):
    index = spark.read.parquet(laid_out)
    wanted = spark.range(40).select(F.lit("q").alias("qid"), F.col("id").cast("string").alias("doc_id"))
    small, large = (sorted(r.id for r in chunks_of(wanted, index, **b).collect()) for b in ({}, {"max_rows": 3, "hot_rows": 2}))
    assert small == large == sorted(r.id for r in chunk_rows_of(spark).collect())
    assert "part_8" not in chunks_of(wanted, index).columns


def test_texts_are_not_in_the_exchanges_of_snippets(spark):
    questions = spark.createDataFrame([(1, "text 5"), (2, "word")], "qid bigint, question string")
    chosen = spark.createDataFrame([(1, 1, 5, "t"), (2, 1, 11, "u")], "qid bigint, pos int, doc_id bigint, title string")
    for index in (chunk_rows_of(spark), chunk_rows_of(spark).drop("n_tokens")):
        index = index.withColumn("embedding", F.array_repeat(F.lit(1.0).cast("float"), 256))
        kept = retrieve_snippets(questions, chosen, index)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", kept._jdf.queryExecution().explainString(mode))
        assert len(moved) >= 3 and not any("document" in columns for columns in moved)


def test_the_embedding_function_sees_a_question_once(spark, tmp_path):
    folder = str(tmp_path)

    def vectors(texts):
        import uuid

        for t in texts:
            open(f"{folder}/{t}-{uuid.uuid4().hex}", "w").close()
        return [[float(len(t)), 1.0] for t in texts]

    index = chunk_rows_of(spark)
    summaries = index.where("chunk_id = 1").select(F.col("doc_id").alias("id"), F.create_map(F.lit("title"), F.col("document")).alias("metadata"), "embedding")
    queries = spark.createDataFrame([(q, 0, f"q{q}") for q in range(9)], "qid bigint, qpos int, query string")
    cfg = AnswerConfig(vectors=vectors, summary_results=3)
    chosen = shortlist_docs(queries, summaries, cfg).cache()
    chosen.count()
    assert len(list(tmp_path.iterdir())) == 9
    asked = queries.select("qid", F.concat(F.lit("full"), "query").alias("question"))
    assert context_of(asked, chosen, index, cfg).count() == 9
    assert len(list(tmp_path.iterdir())) == 18


def test_a_join_without_hot_keys_is_not_salted(spark):
    """Beyond a broadcast the large side is shuffled by the key alone, unless a key has very many rows."""
    large = spark.range(200).select((F.col("id") % 20).alias("k"), "id")
    chosen = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    for hot_rows, salted in ((1_000, False), (5, True)):
        joined = join_chosen(large, chosen, "k", salt_by=["id"], max_rows=0, hot_rows=hot_rows)
        assert ("_salt" in joined._jdf.queryExecution().analyzed().toString()) == salted
        assert sorted(r.id for r in joined.collect()) == [i for i in range(200) if i % 20 in (1, 2)]
