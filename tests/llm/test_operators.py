from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bpe, lines, packing, quality, reputation, sharding, token_counts
from folioscope.session import run_dir
from tests.llm.conftest import corpus


def sql_rows(sql: str, **tables) -> Counter:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


def spark_rows(df) -> Counter:
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


EDGES = [(1, None), (2, ""), (3, " \n \t\n"), (4, "#*$ | <> & %"), (5, "a b c a b c a b c " * 20), (6, "the of and " * 30), (6, "the of and " * 30),
         (None, "x\x0by\x0cz\r\nx\x0by\x0cz"), (7, "ein wort\n" * 60), (8, "É é À the of " * 400)]


def test_quality_measures_against_sql(documents):
    docs = documents(EDGES + corpus(21))
    got = quality.judged(docs.select("doc_id", "text"), "doc_id").drop("n_lines", "n_stop_words")
    assert spark_rows(got) == sql_rows(quality.SQL, documents=docs.select("doc_id", "text"))


def test_quality_keeps_good_documents_with_their_columns(documents):
    rng = random.Random(3)
    good = " ".join(rng.choice(["the", "of", "wander", "silent", "harbour", "lantern", "and", "meadow", "crimson"]) + ("." if i % 9 == 8 else "") for i in range(80))
    docs = documents([(1, good), (2, "| ".join(good.split())), (3, "good " * 80), (4, None), (None, good)])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, None])


def test_filters_do_not_repeat_what_they_ask(documents):
    docs = documents(EDGES)
    plan = quality.keep_good(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    plan = lines.without_shared_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except(") == 1


def test_quality_stage_is_not_quadratic_in_the_length_of_a_text(documents):
    text = " ".join(f"word{i} of the" for i in range(20_000))
    assert quality.keep_good(documents([(1, text)])).count() in (0, 1)


def test_quality_runs_without_python(documents):
    plan = quality.judged(documents(EDGES), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Scan")[0].replace("RoundRobin", "")[:0]


LINE = "This line is long enough to count, and everybody has it."


def test_lines_against_sql(documents):
    rows = [(d, f"start {d}\n  {LINE}\x0b\nend\n{LINE.upper()}") for d in range(6)] + [(6, LINE), (6, LINE), (None, LINE), (7, None), (8, ""), (9, "\n\n")]
    rows += [(20 + d, "É" * 40 + "\n" + "é" * 40 + "\nx") for d in range(5)] + [(r[0] + 40 if r[0] is not None else None, r[1]) for r in corpus(22)]
    docs = documents(rows)
    got = lines.dedup_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
    want = sql_rows(lines.SQL, documents=docs.select("doc_id", "text"))
    assert spark_rows(got) == want
    assert sum(r[2] for r in want) > 10


def test_lines_stage_keeps_columns_and_drops_what_is_left_empty(documents):
    docs = documents([(d, LINE) for d in range(5)] + [(5, "a\n" + LINE), (6, None)])
    left = lines.without_shared_lines(docs)
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {(5, "a\n" + LINE), (6, "")}


def test_slots_are_balanced_and_gapless(documents):
    rows = [(d, "x" * (d % 97) + "é") for d in range(3000)] + [(None, None), (None, ""), (7, "again")]
    records = sharding.slotted(documents(rows), 512)
    sizes = sharding.slot_sizes(records, 512)
    first = sharding.first_map(sizes, 24)
    spark = records.sparkSession
    got = sharding.placed(records, spark.createDataFrame(first, sharding.MAP_SCHEMA)).collect()
    assert len(got) == len(rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(load.values()) == sum(len((t or "").encode()) + 8 for _, t in rows)
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    crc = {(r.doc_id, r.text_crc32) for r in got}
    assert crc == {(d, zlib.crc32((t or "").encode())) for d, t in rows}


def test_maps_are_edited_and_versioned(spark):
    rng = random.Random(4)
    sizes = [(s, rng.randrange(1, 1000), 1) for s in range(400)]
    old = sharding.first_map(sizes, 8)
    grown = sharding.rebalanced(old, sizes, 9)
    moved = [(a[1], b[1]) for a, b in zip(old, grown) if a[1] != b[1]]
    assert moved and all(b == 8 for _, b in moved) and len(moved) < 80
    fewer = sharding.rebalanced(grown, sizes, 7)
    load = Counter()
    for _, shard, size, _ in fewer:
        load[shard] += size
    assert set(load) == set(range(7)) and max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 7
    folder = run_dir(spark, "maps")
    sharding.write_map(spark, old, folder, 1)
    sharding.write_map(spark, grown, folder, 2)
    assert [tuple(r) for r in sharding.read_map(spark, folder, 2).orderBy("slot").collect()] == grown
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sharding.write_map(spark, old, folder, 2)
    assert sharding.rebalanced(old, sizes, 8) == old


def plain_ids(text):
    from tokenizers import Tokenizer

    global _plain
    try:
        _plain
    except NameError:
        _plain = Tokenizer.from_file(packing.tokenizer_path())
    return _plain.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "It's 12 o'clock,  isn't\n\n it?  ", "é à Üß 日本語 \x1c x", "<|endoftext|> here", "tab\t\ttab \r\n", "x" * 300, "no\u00a0break \u2003 wide", "ǅ Ɏ ª º µ ²¼", "word " * 40_000,
         "a" * 70_000 + " b", "1 2  3   4\n \n5", "'S 'T 'll've"]


def test_encoder_agrees_with_the_library():
    encoder = bpe.Encoder(packing.tokenizer_path())
    for text in TEXTS + [t for _, t in corpus(31) if t]:
        assert encoder.encode(text).tolist() == plain_ids(text), text[:40]


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KNOWN", 8)
    encoder = bpe.Encoder(packing.tokenizer_path())
    for text in ("one two three four", "five six seven eight nine ten eleven", "one two three four five six seven eight"):
        assert encoder.encode(text).tolist() == plain_ids(text)


def test_long_texts_are_cut_where_tokens_begin():
    text = " ".join(f"w{i}," for i in range(30_000))
    assert len(bpe.cut_long(text)) > 2 and "".join(bpe.cut_long(text)) == text
    assert [i for p in bpe.cut_long(text) for i in plain_ids(p)] == plain_ids(text)


def test_packing_is_a_round_trip(documents):
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice(["ab", "c", "long er"]) for _ in range(rng.randrange(0, 90)))) for d in range(300)]
    rows += [(400, None), (401, ""), (None, "x y"), (3, rows[3][1]), (402, "word " * 500)]
    got = packing.pack_documents(documents(rows), packing.tokenizer_path(), window=64, keep_ids=True, group_pieces=120).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append(r)
        pieces[(r.doc_id, r.start)].append(r.ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 64
    want = Counter()
    for d, t in rows:
        ids = plain_ids(t or "") + [1]
        for s in range(0, len(ids), 64):
            want[(d, s, tuple(ids[s:s + 64]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in got) == want
    padding = 1 - sum(r.length for r in got) / (64 * len(sequences))
    assert padding < 0.1


def test_packing_places_where_squares_stay_smallest():
    packer = packing.Packer(10)
    assert packer.place(0, 10) == [0]
    assert packer.place(1, 6) is None and packer.place(2, 6) is None  # two windows at level 6
    assert packer.place(3, 4) == [1, 3] or packer.level[6] == 1  # filling one costs least
    brute = packing.Packer(12)
    rng = random.Random(6)
    for i in range(400):
        size = rng.randrange(1, 12)
        before, top = brute.level.copy(), 12 - size
        costs = {}
        for h in range(top + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= 1 if h else 0
            if h + size < 12:
                after[h + size] += 1
            costs[h] = int((after[1:12] ** 2).sum())
        brute.place(i, size)
        assert int((brute.level[1:12] ** 2).sum()) == min(costs.values())


def test_equal_rows_are_packed_in_all_groups(documents):
    got = packing.pack_documents(documents([(1, "same text")] * 2_000), packing.tokenizer_path(), window=64, group_pieces=100).collect()
    assert len(got) == 2_000
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) == 20 and max(groups.values()) < 200


def test_packing_of_nothing(documents):
    assert packing.pack_documents(documents([]), packing.tokenizer_path()).collect() == []


def test_rollup_follows_its_changes(spark, documents):
    docs = documents([(1, "a b"), (2, "a b"), (3, None), (4, "c"), (None, "a b")])
    counts = token_counts.counted(docs, packing.tokenizer_path(), "v1")
    folder = run_dir(spark, "rollup")

    def now():
        return {tuple(r) for r in token_counts.totals(spark, folder).select("tokenizer", "n_docs", "n_tokens", "n_bytes").collect()}

    assert now() == set()
    assert token_counts.commit(token_counts.inserted(counts), folder, "a")
    assert not token_counts.commit(token_counts.inserted(counts), folder, "a")
    n = len(plain_ids("a b"))
    assert now() == {("v1", 5, 3 * n + 1, 10)}
    assert token_counts.commit(token_counts.deleted(counts.where("doc_id = 4")), folder, "b")
    assert now() == {("v1", 4, 3 * n, 9)}
    after = counts.where("doc_id in (1, 2)").withColumn("tokenizer", F.lit("v2")).withColumn("n_tokens", F.lit(7).cast("long"))
    assert token_counts.commit(token_counts.revised(counts.where("doc_id in (1, 2)"), after), folder, "c")
    assert now() == {("v1", 2, n, 3), ("v2", 2, 14, 6)}
    assert token_counts.commit(token_counts.deleted(counts.where("doc_id is null or doc_id = 3")), folder, "d")
    assert now() == {("v2", 2, 14, 6)}


def test_rollup_query_revises_every_row(spark, documents, tmp_path, monkeypatch):
    docs = documents([(1, "one two three"), (2, "one two three"), (3, "other words"), (4, None)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path / "rollup")
    monkeypatch.setattr(token_counts, "run_dir", lambda spark, label: folder)
    got = token_counts.op1_token_rollup(spark, str(tmp_path))
    distinct = token_counts.counted(docs.where("doc_id <> 2"), packing.tokenizer_path(), token_counts.VERSION)
    want = distinct.groupBy(*token_counts.KEY).agg(F.count("*"), F.sum("n_tokens"), F.sum("n_bytes"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    deltas = spark.read.parquet(f"{folder}/deltas").groupBy("batch", "tokenizer").agg(F.sum("n_docs").alias("n")).collect()
    assert {(r.batch, r.tokenizer, r.n) for r in deltas} == {
        ("load", token_counts.BYTES_VERSION, 4), ("revise", token_counts.BYTES_VERSION, -4), ("revise", token_counts.VERSION, 4), ("copies", token_counts.VERSION, -1)}


def test_rollup_writes_an_unfinished_batch_anew(spark, documents):
    counts = token_counts.counted(documents([(1, "a")]), packing.tokenizer_path(), "v1")
    folder = run_dir(spark, "rollup")
    spark.createDataFrame([("s", "l", "v", 9, 9, 9)], token_counts.DELTA_SCHEMA).write.parquet(f"{folder}/deltas/batch=a")
    assert not token_counts.committed(spark, folder, "a") and token_counts.totals(spark, folder).count() == 0
    assert token_counts.commit(token_counts.inserted(counts), folder, "a")
    assert [r.n_docs for r in token_counts.totals(spark, folder).collect()] == [1]


URLS = ["http://A.Example.NET/en/x?q", "https://example.net/de", "http://x.example.com/de/1", "http://x.example.com/fr/", "http://b.org/fr/", "http://b.org", None, "no scheme",
        "http://", "x://h?a/b", "http://notexample.com/de/", "a://b://c/d", "http://h.co.uk/1#x/y", "http://h2.co.uk/", "HTTP://UP.org#f"]


@pytest.mark.parametrize("labelled", [True, False])
def test_reputation_against_sql(spark, labelled):
    rng = random.Random(7)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"http://s{i % 9}.bad{i % 4}.com/{i}") for i in range(200)] + [(None, "http://n.org/"), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = [(i, int(rng.random() > (0.9 if i % 4 == 1 else 0.1)), rng.choice([0, 0, 1, None])) for i in range(0, 320, 2)] + [(101, 0, 1)] * 30 + [(None, 0, 0), (5, None, None)]
    labels = spark.createDataFrame(labels if labelled else [], "doc_id long, quality int, toxic int")
    got = reputation.judged(pages, reputation.outcomes_of(labels)).drop("bound")
    con_rows = duckdb.connect()
    con_rows.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con_rows.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con_rows.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    if labelled:
        con_rows.executemany("INSERT INTO labels VALUES (?, ?, ?)", [tuple(r) for r in labels.collect()])
    want = Counter(con_rows.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({reputation.SQL})").fetchall())
    assert spark_rows(got) == want
    verdicts = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert verdicts[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert verdicts[1][2:] == ("net/", "block") and verdicts[2][2:] == ("example.com/de/", "block") and verdicts[4][2:] == ("org/fr/", "allow")
    assert verdicts[6][:3] == ("", "", None) == verdicts[7][:3]
    assert verdicts[9][:2] == ("h", "") and verdicts[11][:2] == ("b:", "//c/d")
    assert labelled == any(v[3] == "block" and v[2] is None for v in verdicts.values())


def test_suffixes_and_domains(spark):
    hosts = ["a.b.example.com", "x.co.uk", "co.uk", "com", "", "a.com.org", "m.h.gov.br"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(reputation.domain_of(F.col("h")), reputation.suffix_of(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [("example.com", ".com"), ("x.co.uk", ".co.uk"), ("co.uk", "co.uk"), ("com", "com"), ("", ""), ("com.org", ".org"), ("h.gov.br", ".gov.br")]
