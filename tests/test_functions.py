from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions.hooks import complete, normalize_reply
from folioscope.functions.messages import message, message_from_json, message_str, message_to_json, to_request
from folioscope.functions.properties import merge_metadata, metadata_map, parse_properties, prop_value
from folioscope.functions.tokens import Vocabulary
from folioscope.functions.text import content_text, lead_sentences, n_tokens, query_list, strip, two_decimals
from folioscope.operators.relations import resolve_relations

from registry import views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_content_text(spark):
    none = F.expr("cast(array() as array<string>)")
    assert one(spark, content_text(F.lit("t"), F.array(F.lit("c")), F.lit(""))) == "<caption> c <\\caption> t"
    assert one(spark, content_text(F.lit(""), none, F.lit("x"))) == "<equation> x <\\equation> "
    assert one(spark, content_text(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == ""


def test_query_list_keeps_everything(spark):
    assert one(spark, query_list(F.lit("a; b;"))) == ["a", " b", ""]
    assert one(spark, query_list(F.lit(""))) == [""]
    assert one(spark, query_list(F.lit("a.b"), ".")) == ["a", "b"]


def test_tokens_and_sentences(spark):
    assert one(spark, n_tokens(F.lit(" a  bc\nd "))) == 3
    assert one(spark, n_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, n_tokens(F.lit("abc"), list)) == 3
    assert one(spark, lead_sentences(F.lit("A b. C! D"), 2)) == "A b. C!"


def test_strip_is_unicode(spark):
    assert one(spark, strip(F.lit("  a b\n "))) == "a b"


@pytest.mark.parametrize("value", [1.125, 0.575, 1.375, 0.125, 1 / 3, 2.0, 0.995, 3.999, 0.05, 1.005, 0.375, 12.345, sum(1 / r for r in range(1, 21))])
def test_two_decimals(spark, value):
    assert one(spark, two_decimals(F.lit(value))) == f"{value:.2f}"


PROPS = """{"T": {"type": "title", "title": [{"plain_text": "a"}, {}, {"plain_text": "b"}]}, "E": {"type": "title", "title": []},
 "R": {"type": "rich_text", "rich_text": [{"plain_text": "r"}]}, "D": {"type": "date", "date": {"start": "2024-01-02", "end": "2025-01-01"}},
 "N": {"type": "date", "date": null}, "L": {"type": "last_edited_time", "last_edited_time": "then"}, "U": {"type": "files", "files": ["x"]}}"""


def test_property_values(spark):
    bag = spark.createDataFrame([(PROPS,)], "j string").select(parse_properties(F.col("j")).alias("p"))
    row = bag.select(*[prop_value(F.col("p")[k]).alias(k) for k in "TERDNLUX"]).first()
    assert tuple(row) == ("a  b", "", "r", "2024-01-02", None, "then", None, None)
    mapped = bag.select(metadata_map(F.col("p"), {"t": "T", "d": "D", "n": "N", "x": "X"}).alias("m"), metadata_map(F.col("p"), {}).alias("none")).first()
    assert mapped.m == {"t": "a  b", "d": "2024-01-02"} and mapped.none == {}


def test_merge_metadata(spark):
    base = F.create_map(F.lit("title"), F.lit("x"), F.lit("last"), F.lit(None).cast("string"))
    extra = F.create_map(F.lit("title"), F.lit("y"), F.lit("source"), F.lit(None).cast("string"), F.lit("date"), F.lit("d"))
    assert one(spark, merge_metadata(base, extra)) == {"title": "y", "last": None, "date": "d"}
    assert one(spark, merge_metadata(base, F.lit(None).cast("map<string,string>"))) == {"title": "x", "last": None}


def pages(spark, bags):
    return spark.createDataFrame(list(bags.items()), "page_id string, j string").select("page_id", parse_properties(F.col("j")).alias("properties"))


def test_relations(spark):
    bags = {
        "a": '{"T": {"type": "title", "title": [{"plain_text": "A"}]}, "Rel": {"type": "relation", "relation": [{"id": "c"}, {"id": "b"}, {"id": "zz"}]}}',
        "b": '{"T": {"type": "title", "title": [{"plain_text": "B"}, {"plain_text": "b"}]}, "Rel": {"type": "relation", "relation": []}}',
        "c": '{"T": {"type": "title", "title": [{"plain_text": "C"}]}, "Rel": {"type": "relation", "relation": null}}',
        "d": '{"T": {"type": "title", "title": [{"plain_text": "D"}]}}',
    }
    df = pages(spark, bags)
    found = resolve_relations(df, ["Rel"])
    text = found.select("page_id", prop_value(F.col("properties")["Rel"], F.col("related")["Rel"]).alias("v"))
    assert {r.page_id: r.v for r in text.collect()} == {"a": "C;B b", "b": "", "c": None, "d": None}
    with pytest.raises(Exception, match="no page for relation"):
        resolve_relations(df, ["Rel"], strict=True).collect()


def test_messages(spark):
    msg = message("user", F.lit('hi "x"'), F.lit("2024-01-01T00:00:00"))
    assert one(spark, message_from_json(message_to_json(msg))).asDict() == {"role": "user", "content": 'hi "x"', "timestamp": "2024-01-01T00:00:00"}
    assert one(spark, message_str(msg)) == 'user: hi "x"'
    assert one(spark, to_request(F.array(msg)))[0].asDict() == {"role": "user", "content": 'hi "x"'}
    assert one(spark, message("system", F.lit("x")))["timestamp"].startswith("20")
    with pytest.raises(ValueError):
        message("robot", F.lit("x"))
    for bad in ('{"role": "user", "content": "x", "more": 1}', '{"role": "user"}', "nonsense"):
        with pytest.raises(Exception):
            one(spark, message_from_json(F.lit(bad)))


def test_complete_and_normalize(spark):
    def fn(messages):
        asked = messages[-1]["content"]
        if asked == "bad":
            return {"role": "user", "content": "x"}, {}
        return {"role": "assistant", "content": f"  {asked.upper()}\n"}, {"completion_tokens": 1, "prompt_tokens": len(messages)}

    rows = [(i, q) for i, q in enumerate(["a", "b", "bad"])]
    asked = spark.createDataFrame(rows, "id int, q string").select("id", F.array(message("system", F.lit("s")), message("user", F.col("q"))).alias("messages"))
    out = {r.id: r for r in normalize_reply(complete(asked, fn, 2)).collect()}
    assert [(out[i].ok, out[i].reply_content, out[i].completion_tokens, out[i].prompt_tokens) for i in range(3)] == [
        (True, "A", 1, 2), (True, "B", 1, 2), (False, "x", None, None)]
    with pytest.raises(Exception, match="unexpected reply role"):
        normalize_reply(complete(asked, fn, 2), strict=True).collect()


def test_completion_map_keeps_to_its_parallelism(spark, tmp_path):
    def slow(messages, mark):
        import time

        started = time.time()
        time.sleep(0.05)
        return {"role": "assistant", "content": f"{mark} {started} {time.time()}"}, {}

    asked = spark.range(60).repartition(8).select("id", F.array(message("user", F.col("id").cast("string"))).alias("messages"))
    got = complete(asked, slow, parallelism=3, options={"mark": "m"})
    first = got.collect()
    assert {r.id for r in first} == set(range(60))
    spans = [tuple(map(float, r.reply_content.split(" ")[1:])) for r in first]
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 3
    assert sorted(got.collect()) == sorted(first)  # a second action asks nothing


def counting(folder, fail_on=None):
    """A model that leaves a file per call, and dies once at the message ``fail_on``."""
    def fn(messages):
        import os
        import time
        import uuid

        asked = messages[-1]["content"]
        if asked == fail_on and not os.path.exists(f"{folder}/died"):
            time.sleep(4)  # the other tasks are done by then
            open(f"{folder}/died", "w").close()
            raise RuntimeError("lost")
        open(f"{folder}/call-{asked}-{uuid.uuid4().hex}", "w").close()
        return {"role": "assistant", "content": asked.upper()}, {"completion_tokens": 1, "prompt_tokens": 1}

    return fn


def calls_in(folder):
    return Counter(p.name.split("-")[1] for p in folder.iterdir() if p.name.startswith("call-"))


def requests_of(spark, n):
    return spark.range(n).select("id", F.array(message("user", F.concat(F.lit("m"), "id"))).alias("messages"))


def test_a_task_that_dies_repeats_its_own_calls_only(spark, tmp_path):
    seen, log = tmp_path / "seen", str(tmp_path / "log")
    seen.mkdir()
    asked = requests_of(spark, 60)
    fn = counting(str(seen), "m33")
    with pytest.raises(Exception, match="lost"):
        complete(asked, fn, parallelism=3, log=log)
    once = calls_in(seen)
    kept = {r.reply_content.lower() for r in spark.read.parquet(log).collect()}
    assert len(kept) == 40 and kept <= set(once)  # what the other two tasks had
    got = complete(asked, fn, parallelism=3, log=log)
    assert {r.id: r.reply_content for r in got.collect()} == {i: f"M{i}" for i in range(60)}
    repeated = {m for m, n in calls_in(seen).items() if n > 1}
    assert repeated == set(once) - kept and len(repeated) < 20


def test_a_rerun_sends_what_the_log_lacks(spark, tmp_path):
    seen, log = tmp_path / "seen", str(tmp_path / "log")
    seen.mkdir()
    fn = counting(str(seen))
    complete(requests_of(spark, 5), fn, log=log).collect()
    got = complete(requests_of(spark, 8), fn, log=log)
    assert got.count() == 8 and sum(r.completion_tokens for r in got.collect()) == 8
    assert calls_in(seen) == Counter(f"m{i}" for i in range(8))
    complete(requests_of(spark, 8), lambda messages, heat: fn(messages), options={"heat": 1}, log=log)
    assert calls_in(seen) == Counter({f"m{i}": 2 for i in range(8)})  # other options, other requests
    assert complete(requests_of(spark, 0), fn, log=log).count() == 0


def test_many_requests_are_sent_by_one_job(spark, tmp_path):
    asked = requests_of(spark, 20_000)
    spark.sparkContext.setJobGroup("completions", "")
    try:
        got = complete(asked, parallelism=4, log=str(tmp_path / "log"))
        assert got.count() == 20_000
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("completions")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    few = requests_of(spark, 20)
    spark.sparkContext.setJobGroup("few", "")
    try:
        assert complete(few, parallelism=4, log=str(tmp_path / "few")).count() == 20
        assert len(jobs) <= len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) + 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scores_near_nothing(spark):
    values = [0.0, 0.004, 0.005, 0.0149, 0.015, 0.025, 0.031, 1 / 200, 1 / 32, 0.125, 0.575]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == {v: f"{v:.2f}" for v in values}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_vocabulary_counts_equal_the_plain_library(spark, name):
    from tokenizers import Tokenizer

    path = views.vocabulary_path(name)
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    odd = spark.createDataFrame([(None,), ("",), (" \n\t x  y",), ("a <|endoftext|> b",), ("don't they'll 123 \u00e9\u4f60\u597d \U0001f600",), ("x" * 300_000,)], "text string")
    for r in docs.unionByName(odd).select("text", n_tokens(F.col("text"), Vocabulary(path)).alias("n")).collect():
        assert r.n == (len(plain.encode(r.text, add_special_tokens=False).ids) if r.text else 0)


def test_a_distinct_pre_token_is_counted_once():
    calls, vocabulary = [], Vocabulary(views.vocabulary_path())
    tokenizer = vocabulary._tokenizer()

    class Model:
        def tokenize(self, piece):
            calls.append(piece)
            return tokenizer.model.tokenize(piece)

    class Watched:
        normalizer, pre_tokenizer, model = tokenizer.normalizer, tokenizer.pre_tokenizer, Model()
        get_added_tokens_decoder = tokenizer.get_added_tokens_decoder

    vocabulary._loaded = Watched()
    assert vocabulary.counts(["the house the house", None, " the house"] * 50)[1] == 0
    assert len(calls) == len(set(calls)) == 3


def test_requests_reach_the_model_in_batches_bounded_in_bytes(spark):
    """Long requests are not held in Python by the thousand: the worker of the map stays small."""
    def watched(messages):
        import resource

        return {"role": "assistant", "content": "x"}, {"completion_tokens": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}

    def peak(chars):
        asked = spark.range(3_000).select("id", F.array(message("user", F.concat(F.repeat(F.lit("x"), chars), F.col("id").cast("string")))).alias("messages"))
        return complete(asked, watched, parallelism=1).agg(F.max("completion_tokens")).first()[0]

    few = peak(10)
    assert peak(100_000) < few + 150  # 300 MB of requests
