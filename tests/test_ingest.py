import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.plans import ingest
from folioscope.plans.answer import AnswerConfig, answer, answer_context, split_queries, transcript
from folioscope.plans.ingest import IndexConfig, LoaderConfig, Source, open_indexes, run_ingest
from folioscope.sources import tables
from folioscope.schema import BLOCKS, MARKS, PAGES, SUMMARY_INDEX
from folioscope.operators.usage import usage_by
from folioscope.sources.pages import changed_pages, page_blocks, write_page_log
from folioscope.operators.blocks import read_blocks
from folioscope.sources.raw import raw_blocks, raw_pages
from folioscope.sources.tables import latest_per_key, open_index, read_mark, stamp, stamp_text, upsert, write_batch, write_mark
from folioscope.streaming.ingest import index_stream, ingest_stream, usage_stream

ROWS = "id string, at int, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_upsert_twice_is_once(spark):
    index, batch = frame(spark, [("a", 1, "x"), ("b", 1, "y")]), frame(spark, [("b", 2, "z"), ("c", 2, "w")])
    once = upsert(index, batch)
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 2, "w")]
    assert sorted(map(tuple, upsert(once, batch).collect())) == sorted(map(tuple, once.collect()))


def test_latest_per_key(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 3, "y"), ("a", 2, None), ("b", 5, None)])
    assert sorted(map(tuple, latest_per_key(df, "id", ["at"]).collect())) == [("a", 3, "y"), ("b", 5, None)]


@pytest.mark.parametrize("order", [(), ("at",)])
def test_table_versions(spark, tmp_path, order):
    path, schema = str(tmp_path / "t"), frame(spark, []).schema
    read = lambda: sorted(map(tuple, open_index(spark, path, schema).collect()))
    put = lambda *rows: write_batch(frame(spark, list(rows)), path, order=order, parts=3)
    assert read() == []
    put()
    assert read() == []
    put(("a", 1, "x"), ("b", 1, "y"))
    put(("b", 2, "z"), ("c", 2, "w"))
    held = open_index(spark, path, schema)
    assert read() == [("a", 1, "x"), ("b", 2, "z"), ("c", 2, "w")]
    put(("a", 0, "old"))
    assert read()[0] == (("a", 1, "x") if order else ("a", 0, "old"))
    put(("a", 9, "new"))
    put(("a", 9, "new"))  # a repeated batch changes nothing
    put(*((f"k{i}", i, None) for i in range(20)))
    assert read() == [("a", 9, "new"), ("b", 2, "z"), ("c", 2, "w"), *sorted((f"k{i}", i, None) for i in range(20))]
    assert sorted(map(tuple, held.collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 2, "w")]  # what was opened stays as it was


def test_an_upsert_leaves_parts_alone_that_it_does_not_touch(spark, tmp_path):
    path, schema = str(tmp_path / "t"), frame(spark, []).schema
    write_batch(frame(spark, [(f"k{i}", 0, "x") for i in range(40)]), path, parts=8)
    before, parts = tables._folders(spark, path, tables._pointers(spark, path)[0])
    write_batch(frame(spark, [("k3", 1, "y")]), path)
    after, same = tables._folders(spark, path, tables._pointers(spark, path)[0])
    assert parts == same == 8 and sum(before[p] != after[p] for p in before) == 1
    assert sorted(r.id for r in open_index(spark, path, schema).collect()) == sorted(f"k{i}" for i in range(40))


def test_batch_that_fails_before_its_pointer_is_not_lost(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), frame(spark, []).schema
    read = lambda: sorted(map(tuple, open_index(spark, path, schema).collect()))

    def down(*args, **kwargs):
        raise OSError("store is down")

    with monkeypatch.context() as broken:
        broken.setattr(tables, "_point", down)
        with pytest.raises(OSError):
            write_batch(frame(spark, [("a", 1, "slow")]), path)
    assert read() == []
    write_batch(frame(spark, [("b", 1, "other")]), path)
    write_batch(frame(spark, [("a", 1, "slow")]), path)
    assert read() == [("a", 1, "slow"), ("b", 1, "other")]
    # A pointer that was not written to its end is passed over, and its number is not used again.
    (tmp_path / "t" / "pointer" / "3").mkdir()
    assert read() == [("a", 1, "slow"), ("b", 1, "other")]
    write_batch(frame(spark, [("c", 1, "next")]), path)
    assert [r[0] for r in read()] == ["a", "b", "c"]


def test_two_writers_fail(spark, tmp_path):
    path = str(tmp_path / "t")
    write_batch(frame(spark, [("a", 1, "x")]), path)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables._point(spark, path, 1, {0: "other"}, 16)


def test_edits_with_the_stamp_of_the_mark_are_read(spark, tmp_path):
    root = str(tmp_path / "root")
    blocks = spark.createDataFrame([block(p, 0, "paragraph", p) for p in ("p1", "p2", "p3")], BLOCKS)
    cfg = LoaderConfig(edited="Edited")
    seen = []
    for names in (["p1"], ["p1", "p2"], ["p1", "p2"], ["p1", "p2", "p3"]):  # all of one stamp
        pages = spark.createDataFrame([page(p, 5, p) for p in names], PAGES)
        seen.append(run_ingest(spark, [Source("main", pages, blocks, cfg)], root)["main"])
    assert seen == [True, True, False, True]
    assert {r.id for r in open_indexes(spark, root)["summary"].collect()} == {"p1", "p2", "p3"}


def test_another_edit_of_a_page_within_one_stamp_is_read(spark, tmp_path):
    root, cfg = str(tmp_path / "root"), LoaderConfig(edited="Edited")

    def run(title, *texts):
        pages = spark.createDataFrame([page("p1", 5, title), page("p2", 5, "other")], PAGES)
        blocks = spark.createDataFrame([block("p1", i, "paragraph", t) for i, t in enumerate(texts)] + [block("p2", 0, "paragraph", "x")], BLOCKS)
        fed = run_ingest(spark, [Source("main", pages, blocks, cfg)], root)["main"]
        stored = {kind: {r.id: r for r in df.collect()} for kind, df in open_indexes(spark, root).items()}
        return fed, stored["chunk"]["p1_1"].document, stored["summary"]["p1"].metadata["title"], stored["chunk"]["p2_1"].document

    assert run("one", "a") == (True, "\na", "one", "\nx")
    assert run("one", "a", "b") == (True, "\na\n\nb", "one", "\nx")  # blocks alone
    assert run("two", "a", "b") == (True, "\na\n\nb", "two", "\nx")  # properties alone


def test_marks(spark, tmp_path):
    path = str(tmp_path / "marks")
    loaders = spark.createDataFrame([("a",), ("b",)], "loader string")
    state = lambda: open_index(spark, path, MARKS)
    text = lambda: {r.loader: r.t for r in read_mark(state(), loaders).select("loader", stamp_text(F.col("ts")).alias("t")).collect()}
    assert text() == {"a": "1970-01-01T00:00:00.000000+00:00", "b": "1970-01-01T00:00:00.000000+00:00"}
    write_mark(spark.sql("SELECT 'a' AS loader").withColumn("ts", stamp(F.lit("2024-01-01T02:00:00+02:00"))), path)
    write_mark(spark.sql("SELECT 'a' AS loader").withColumn("ts", stamp(F.lit("2024-01-02T00:00:00+00:00"))), path)
    assert text()["a"] == "2024-01-02T00:00:00.000000+00:00" and text()["b"].startswith("1970")


def test_stream_equals_batch_whatever_the_slices(spark, tmp_path):
    rows = [(f"k{i % 7}", i, f"v{i}") for i in range(60)]
    df = frame(spark, rows)
    expected = sorted(map(tuple, latest_per_key(df, "id", ["at"]).collect()))
    for name, slices in (("one", [rows]), ("two", [rows[30:], rows[:30]])):  # the newer half may come first
        source, path, checkpoint = (str(tmp_path / name / part) for part in ("in", "table", "checkpoint"))
        for part in slices:
            frame(spark, part).coalesce(1).write.mode("append").parquet(source)
            ingest_stream(spark, source, df.schema, path, checkpoint, "id", ["at"]).awaitTermination()
        assert sorted(map(tuple, open_index(spark, path, df.schema).collect())) == expected
        ingest_stream(spark, source, df.schema, path, checkpoint, "id", ["at"]).awaitTermination()  # nothing new
        assert sorted(map(tuple, open_index(spark, path, df.schema).collect())) == expected


def page(page_id, day, title, source=None):
    bag = {"Title": {"type": "title", "title": [{"plain_text": title}]},
           "Edited": {"type": "last_edited_time", "last_edited_time": f"2024-01-{day:02}"}}
    if source:
        bag["Source"] = {"type": "rich_text", "rich_text": [{"plain_text": source}]}
    full = {k: {**dict.fromkeys(["title", "rich_text", "relation", "date", "last_edited_time"]), **v} for k, v in bag.items()}
    return (page_id, dt.datetime(2024, 1, day), full)


def block(page_id, pos, btype, text):
    return (page_id, pos, btype, [{"plain_text": text}], [], None)


def test_ingest_then_answer(spark, tmp_path):
    root = str(tmp_path / "root")
    blocks = spark.createDataFrame(
        [block("p1", 0, "heading_1", "Cats"), block("p1", 1, "paragraph", "Cats sleep all day. They purr."),
         block("p2", 0, "paragraph", "Dogs bark at night."), block("p3", 0, "paragraph", "Fish swim.")], BLOCKS)
    cfg = LoaderConfig(edited="Edited", metadata={"source": "Source"}, max_tokens=8)
    first = spark.createDataFrame([page("p1", 1, "On cats", "zoo"), page("p2", 2, "On dogs")], PAGES)
    assert run_ingest(spark, [Source("main", first, blocks, cfg)], root) == {"main": True}
    assert run_ingest(spark, [Source("main", first, blocks, cfg)], root) == {"main": False}

    chunks = {r.id: r for r in open_indexes(spark, root)["chunk"].collect()}
    assert {k: r.document for k, r in chunks.items()} == {"p1_1": "\nCats\nCats sleep all day. They purr.", "p2_1": "\nDogs bark at night."}
    assert chunks["p1_1"].metadata == {"title": "On cats", "last_edited_time": "2024-01-01", "doc_id": "p1", "chunk_id": "1", "source": "zoo"}
    assert len(chunks["p1_1"].embedding) == 256

    second = spark.createDataFrame([page("p1", 1, "On cats", "zoo"), page("p2", 9, "On puppies"), page("p3", 5, "On fish")], PAGES)
    assert run_ingest(spark, [Source("main", second, blocks, cfg)], root) == {"main": True}
    indexes = open_indexes(spark, root)
    titles = {r.id: r.t for r in indexes["summary"].select("id", F.col("metadata")["title"].alias("t")).collect()}
    assert titles == {"p1": "On cats", "p2": "On puppies", "p3": "On fish"}

    def expand(messages):
        return {"role": "assistant", "content": "cats sleep;do cats purr"}, {"completion_tokens": 5, "prompt_tokens": 2}

    def reply(messages):
        assert [m["role"] for m in messages] == ["system", "system", "user"]
        return {"role": "assistant", "content": messages[0]["content"] + " "}, {"completion_tokens": 1, "prompt_tokens": 1}

    questions = spark.createDataFrame([("q1", "How do cats sleep?")], "qid string, question string")
    got = answer(questions, indexes["summary"], indexes["chunk"], expand, reply, AnswerConfig(threshold=1.0)).collect()
    assert [(r.qid, r.completion_tokens, r.prompt_tokens) for r in got] == [("q1", 6, 3)]
    assert "Cats sleep all day" in got[0].answer and got[0].answer.startswith("======\n document 1\n title ")


def test_failed_ingest_keeps_the_mark(spark, tmp_path):
    root = str(tmp_path / "root")
    pages = spark.createDataFrame([page("p1", 1, "t")], PAGES)
    blocks = spark.createDataFrame([block("p1", 0, "paragraph", "x")], BLOCKS)

    def broken(messages):
        raise RuntimeError("model is down")

    cfg = LoaderConfig(edited="Edited")
    with pytest.raises(Exception, match="model is down"):
        run_ingest(spark, [Source("main", pages, blocks, cfg)], root, IndexConfig(summary=broken))
    assert run_ingest(spark, [Source("main", pages, blocks, cfg)], root) == {"main": True}


def test_max_blocks(spark):
    blocks = spark.createDataFrame([block("p", i, "paragraph", str(i)) for i in range(5)] + [block("q", 0, "paragraph", "x")], BLOCKS)
    pages = spark.createDataFrame([("p",)], "page_id string")
    assert page_blocks(blocks, pages).count() == 5 and page_blocks(blocks, pages, 2).count() == 2


def test_question_without_documents_has_no_context(spark):
    empty = spark.createDataFrame([], SUMMARY_INDEX)
    questions = spark.createDataFrame([("q", "x")], "qid string, question string")
    queries = split_queries(questions.withColumn("reply", F.lit("a;b")))
    chunks = spark.createDataFrame([], "id string, doc_id string, chunk_id int, document string, embedding array<float>")
    assert answer_context(questions, queries, empty, chunks).count() == 0


def test_every_question_gets_an_answer_row(spark):
    empty = spark.createDataFrame([], SUMMARY_INDEX)
    chunks = spark.createDataFrame([], "id string, doc_id string, chunk_id int, document string, embedding array<float>")
    questions = spark.createDataFrame([("q", "x")], "qid string, question string")

    def expand(messages):
        return {"role": "assistant", "content": "a;b"}, {"completion_tokens": 3, "prompt_tokens": 4}

    said = transcript(questions, empty, chunks, expand, expand).orderBy("seq").collect()
    assert [(r.seq, r.content, r.completion_tokens) for r in said] == [(0, "Expanding your queries: \n a;b\n", 3), (1, "No relevant documents found.\n", None)]
    row, = answer(questions, empty, chunks, expand, expand).collect()
    assert (row.qid, row.answer, row.completion_tokens, row.prompt_tokens) == ("q", None, 3, 4)


def test_page_stream_equals_run(spark, tmp_path):
    blocks = spark.createDataFrame([block(p, i, "paragraph", f"{p} {i}") for p in ("p1", "p2") for i in range(4)], BLOCKS)
    cfg = LoaderConfig(edited="Edited", max_tokens=4)
    edits = [[page("p1", 1, "one"), page("p2", 2, "two")], [page("p1", 3, "later"), page("p1", 4, "last")]]
    source, root = str(tmp_path / "in"), str(tmp_path / "stream")
    for part in edits:
        spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(PAGES).parquet(source), blocks, root, str(tmp_path / "check"), cfg=cfg).awaitTermination()
    final = spark.createDataFrame([edits[0][1], edits[1][1]], PAGES)
    run_ingest(spark, [Source("main", final, blocks, cfg)], str(tmp_path / "run"))
    streamed, ran = open_indexes(spark, root), open_indexes(spark, str(tmp_path / "run"))
    for kind in ("summary", "chunk"):
        assert sorted(map(str, streamed[kind].collect())) == sorted(map(str, ran[kind].collect()))


def test_raw_json(spark):
    pages = spark.createDataFrame([('{"id": "p", "last_edited_time": "2024-01-02T03:00:00.000Z", "properties": {"T": {"type": "title", "title": [{"plain_text": "x"}]}}}',)], "page string")
    row = raw_pages(pages).select("page_id", stamp_text(F.col("last_edited")).alias("at"), F.col("properties")["T"]["title"][0]["plain_text"].alias("t")).first()
    assert tuple(row) == ("p", "2024-01-02T03:00:00.000000+00:00", "x")
    blocks = ['{"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "a"}, {"plain_text": "b"}], "caption": ["c"]}}',
              '{"type": "code", "code": {"rich_text": [], "caption": [{"type": "text", "plain_text": "d"}, {"plain_text": "{e"}, "{f"]}}',
              '{"type": "equation", "equation": {"expression": "e=1"}}', '{"type": "divider", "divider": {}}', '{"type": "to_do"}']
    rows = read_blocks(raw_blocks(spark.createDataFrame([("p", blocks)], "page_id string, blocks array<string>"))).orderBy("pos").collect()
    assert [(r.pos, r.btype, r.text) for r in rows] == [
        (0, "paragraph", "<caption> c <\\caption> ab"), (1, "code", "<caption> d{e{f <\\caption> "),
        (2, "equation", "<equation> e=1 <\\equation> "), (3, "divider", ""), (4, "to_do", "")]


def test_late_and_repeated_edits_of_a_page_stream(spark, tmp_path):
    """An old edit that comes late, in the same batch, in a later one and after a restart, never takes the place of a newer one."""
    blocks = spark.createDataFrame([block(p, 0, "paragraph", p) for p in ("p1", "p2", "p3")], BLOCKS)
    source, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "check")
    titles = lambda: {r.id: r.metadata["title"] for r in open_indexes(spark, root)["summary"].collect()}

    def arrive(*batches):
        for rows in batches:
            spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(source)
        index_stream(stream, blocks, root, checkpoint, cfg=LoaderConfig(edited="Edited")).awaitTermination()
        return titles()

    assert arrive([page("p1", 5, "five"), page("p1", 3, "three"), page("p2", 2, "two")]) == {"p1": "five", "p2": "two"}
    assert arrive([page("p1", 4, "four"), page("p2", 2, "two")], [page("p2", 6, "six"), page("p3", 1, "one")]) == {"p1": "five", "p2": "six", "p3": "one"}
    assert arrive([page("p1", 1, "first"), page("p2", 5, "late"), page("p3", 1, "one again")]) == {"p1": "five", "p2": "six", "p3": "one again"}


def test_summaries_of_a_run_that_failed_are_not_paid_for_again(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path / "root"), tmp_path / "calls"
    seen.mkdir()
    folder = str(seen)

    def model(messages):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return {"role": "assistant", "content": "short"}, {"completion_tokens": 1, "prompt_tokens": 1}

    pages = spark.createDataFrame([page(f"p{i}", 1, "t") for i in range(6)], PAGES)
    blocks = spark.createDataFrame([block(f"p{i}", 0, "paragraph", "x") for i in range(6)], BLOCKS)
    source = Source("main", pages, blocks, LoaderConfig(edited="Edited"))

    def down(batch, path, *args, **kwargs):
        if path.endswith("/summary"):
            raise OSError("store is down")
        write_batch(batch, path, *args, **kwargs)

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "write_batch", down)
        with pytest.raises(OSError):
            run_ingest(spark, [source], root, IndexConfig(summary=model))
    assert len(list(seen.iterdir())) == 6
    assert run_ingest(spark, [source], root, IndexConfig(summary=model)) == {"main": True}
    assert len(list(seen.iterdir())) == 6 and {r.document for r in open_indexes(spark, root)["summary"].collect()} == {"short"}


def test_usage_of_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "model string, completion_tokens bigint, prompt_tokens bigint, response_us bigint"
    rows = [(f"m{i % 3}", i if i % 4 else None, 2 * i, 10 * i) for i in range(40)]
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    for part in (rows[:15], rows[15:25], rows[25:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(folder)
        usage_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), path, checkpoint, ["model"]).awaitTermination()
    want = usage_by(spark.createDataFrame(rows, schema), ["model"], "response_us")
    assert sorted(map(tuple, open_index(spark, path, want.schema).collect())) == sorted(map(tuple, want.collect()))


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, "")
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_sources_take_no_more_jobs_than_two(spark, tmp_path):
    def sources(n):
        pages = spark.createDataFrame([page(f"s{s}-p{i}", s % 27 + 1, f"t{s}") for s in range(n) for i in range(2)], PAGES)
        blocks = spark.createDataFrame([block(f"s{s}-p{i}", 0, "paragraph", f"{s} {i}") for s in range(n) for i in range(2)], BLOCKS)
        return [Source(f"s{s}", pages.filter(F.col("page_id").startswith(f"s{s}-")), blocks, LoaderConfig(edited="Edited")) for s in range(n)]

    counts = {}
    for n in (2, 20):
        root = str(tmp_path / f"root{n}")
        fed, counts[n] = jobs_of(spark, f"sources{n}", lambda: run_ingest(spark, sources(n), root))
        assert fed == {f"s{s}": True for s in range(n)}
        assert open_indexes(spark, root)["chunk"].count() == 2 * n
        marks = {r.loader: r.t[:10] for r in open_index(spark, f"{root}/marks", MARKS).select("loader", stamp_text(F.col("ts")).alias("t")).collect()}
        assert marks == {f"s{s}": f"2024-01-{s % 27 + 1:02}" for s in range(n)}
    assert counts[20] <= counts[2] + 8  # stages of larger inputs may be re-planned


def test_sources_keep_marks_settings_and_relations_of_their_own(spark, tmp_path):
    """Equal page ids in two sources: each sees its own blocks; of the index row the last source stays."""
    root = str(tmp_path / "root")
    one, two = ([page("x", 3, "X one"), page("y", 4, "Y")], [page("x", 2, "X two")])
    cfg, other = LoaderConfig(edited="Edited"), LoaderConfig(edited="Edited", metadata={"source": "Source"})
    made = [Source(name, spark.createDataFrame(rows, PAGES), spark.createDataFrame([block(r[0], 0, "paragraph", f"{name} {r[0]}") for r in rows], BLOCKS), c)
            for name, rows, c in (("a", one, cfg), ("b", two, cfg), ("c", [page("z", 1, "Z", "zoo")], other))]
    assert run_ingest(spark, made, root) == {"a": True, "b": True, "c": True}
    chunks = {r.id: r for r in open_indexes(spark, root)["chunk"].collect()}
    assert {k: r.document for k, r in chunks.items()} == {"x_1": "\nb x", "y_1": "\na y", "z_1": "\nc z"}
    assert chunks["x_1"].metadata["title"] == "X two" and chunks["z_1"].metadata["source"] == "zoo" and "source" not in chunks["x_1"].metadata
    assert run_ingest(spark, made, root) == {"a": False, "b": False, "c": False}


def test_a_page_log_reads_the_days_from_the_mark_on(spark, tmp_path):
    path = str(tmp_path / "log")
    pages = spark.createDataFrame([page(f"p{d}", d, "t") for d in range(1, 29)], PAGES)
    write_page_log(pages.filter("day(last_edited) % 2 = 0"), path)
    write_page_log(pages.filter("day(last_edited) % 2 = 1"), path)
    schema = spark.read.parquet(path).schema
    for day in range(1, 18):
        for f in (tmp_path / "log" / f"edit_day=2024-01-{day:02}").glob("*.parquet"):
            f.write_bytes(b"nobody reads this")
    changed = changed_pages(spark.read.schema(schema).parquet(path), stamp(F.lit("2024-01-20T00:00:00+00:00")))
    assert "edit_day" in changed._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.page_id for r in changed.collect()) == sorted(f"p{d}" for d in range(21, 29))


def test_a_micro_batch_asks_the_state_of_its_pages_once(spark, tmp_path, monkeypatch):
    from folioscope.streaming import ingest

    plans = []
    monkeypatch.setattr(ingest, "feed_indexes", lambda batch, *rest: plans.append((batch.count(), batch._jdf.queryExecution().toString())))
    source = str(tmp_path / "in")
    spark.createDataFrame([page("p1", 1, "one"), page("p1", 2, "two"), page("p2", 1, "three")], PAGES).write.parquet(source)
    blocks = spark.createDataFrame([block("p1", 0, "paragraph", "x")], BLOCKS)
    index_stream(spark.readStream.schema(PAGES).parquet(source), blocks, str(tmp_path / "root"), str(tmp_path / "check")).awaitTermination()
    assert [n for n, _ in plans] == [2]
    assert "InPandas" not in plans[0][1]  # what feeds the indexes reads stored pages


def _stored(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_stream_takes_the_room_of_two_versions(spark, tmp_path):
    """Rows are stored once a batch, as the index's own, and what batches before the last one replaced goes."""
    blocks = spark.createDataFrame([block(f"p{i}", j, "paragraph", " ".join(f"w{i * j * n}" for n in range(200))) for i in range(6) for j in range(4)], BLOCKS)
    source, root, sizes, held = str(tmp_path / "in"), str(tmp_path / "stream"), [], []
    for n in range(5):
        spark.createDataFrame([page(f"p{i}", n + 1, f"edit {n}") for i in range(6)], PAGES).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(PAGES).parquet(source), blocks, root, str(tmp_path / "check"), cfg=LoaderConfig(max_tokens=300)).awaitTermination()
        sizes.append(_stored(tmp_path / "stream"))
        held.append(open_indexes(spark, root)["chunk"])
        if n:
            assert {r.metadata["title"] for r in held[-2].collect()} == {f"edit {n - 1}"}  # what was opened before the batch stays readable
    assert {r.metadata["title"] for kind in open_indexes(spark, root).values() for r in kind.collect()} == {"edit 4"}
    assert max(sizes) < 2.5 * sizes[0]


@pytest.mark.parametrize("gather", [True, False])
def test_dropping_older_versions_keeps_the_rows(spark, tmp_path, gather):
    path, schema = str(tmp_path / "t"), frame(spark, []).schema
    want: dict[str, tuple] = {}
    for n in range(6):
        rows = [(f"k{i}", n, f"v{n}") for i in range(n, 40, n + 1)]
        want |= {r[0]: r for r in rows}
        tables.drop_replaced(spark, path)
        batch = tables.store_batch(frame(spark, rows), path, parts=4, gather=gather)
        assert sorted(map(tuple, batch.rows.collect())) == sorted(rows)
        write_batch(batch, path, parts=4)
        assert sorted(map(tuple, open_index(spark, path, schema).collect())) == sorted(want.values())
    folders, _ = tables._folders(spark, path, tables._pointers(spark, path)[0])
    assert all(len(some) <= 2 for some in folders.values())
    assert len(list((tmp_path / "t" / "pointer").iterdir())) == 2


def test_a_batch_that_replaces_everything_moves_no_old_row(spark, tmp_path, monkeypatch):
    path, schema, written = str(tmp_path / "t"), frame(spark, []).schema, []
    write = tables._write_parts
    monkeypatch.setattr(tables, "_write_parts", lambda rows, *rest: written.append(rows.count()) or write(rows, *rest))
    for n in range(3):
        write_batch(frame(spark, [(f"k{i}", n, "x") for i in range(30)]), path)
    assert written == [30, 30, 30] and open_index(spark, path, schema).where("at = 2").count() == 30
