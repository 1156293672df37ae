from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontamination, minhash, substrings, suffixes, words
from folioscope.llm.components import components, merged
from tests.llm.conftest import corpus


def rows_of(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed, hot", [(1, 100_000), (2, 3)])
def test_suffixes_against_the_definition(documents, seed, hot):
    rows = corpus(seed)
    got = suffixes.dedup_bytes(documents(rows), hot_rows=hot).withColumn("sha", F.sha2("kept", 256))
    want = Counter(suffixes.brute_force(rows))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == want
    assert sum(r[2] for r in want) > 1000


def test_suffixes_in_pieces_of_a_long_text(documents):
    rows = corpus(3, 20)
    got = suffixes.dedup_bytes(documents(rows), long_bytes=100, chunk_bytes=500).withColumn("sha", F.sha2("kept", 256))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == Counter(suffixes.brute_force(rows))


@pytest.mark.parametrize("seed, hot", [(4, 100_000), (5, 2)])
def test_windows_against_the_definition(documents, seed, hot):
    rows = corpus(seed)
    got = substrings.dedup_windows(documents(rows), window=12, hot_rows=hot).withColumn("sha", F.sha2("kept", 256))
    want = Counter(substrings.brute_force(rows, 12))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == want
    assert sum(r[2] for r in want) > 200


def test_windows_of_the_production_length(documents):
    rows = corpus(6)
    got = substrings.dedup_windows(documents(rows)).withColumn("sha", F.sha2("kept", 256))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "sha") == Counter(substrings.brute_force(rows))


@pytest.mark.parametrize("seed", [7, 8])
def test_near_duplicates_against_the_definition(documents, seed):
    rows = corpus(seed, 60)
    got = minhash.near_duplicates(documents(rows))
    want = Counter(minhash.brute_force(rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert sum(not r[3] for r in want) > 5


def test_a_pair_at_the_threshold_is_linked_and_one_below_is_not(spark):
    sets = spark.createDataFrame([(1, list(range(9))), (2, list(range(8)) + [20]), (3, list(range(7)) + [30, 31])], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(n, 9, [1] * 32) for n in (1, 2, 3)], "node long, n_shingles long, signature array<int>")
    postings = spark.createDataFrame([(7, n, n) for n in (1, 2, 3)], "key long, node long, label long")
    got = minhash.all_left(postings, nodes, sets, minhash.MATCHES).collect()
    assert {frozenset(r) for r in got} == {frozenset((1, 2))}  # 8 of 10; 7 of 11


def test_rows_that_repeat_a_doc_id_are_linked(documents):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, y), (5, x), (5, y), (6, x + " more"), (7, "alone here")]
    got = minhash.near_duplicates(documents(rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(minhash.brute_force(rows))


def test_many_documents_just_below_the_threshold(documents, monkeypatch):
    """1,500 documents of which any two share most of their words, but too few to be linked; two pairs are links."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(1_500):
        words = list(base)
        for at in rng.choice(72, 9, replace=False) * 4 + 3:
            words[at] = f"v{d}-{at}"
        rows.append((d, " ".join(words)))
    rows += [(2_000, rows[7][1] + " end"), (2_001, rows[9][1] + " end")]
    started = time.perf_counter()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    assert time.perf_counter() - started < 200
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    names = sorted(set().union(*sets))
    place = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(rows), len(names)), np.float32)
    for r, own in enumerate(sets):
        m[r, [place[n] for n in own]] = 1
    shared, size = m @ m.T, m.sum(axis=1)
    label = list(range(len(rows)))
    links = [(a, b) for a, b in zip(*np.nonzero(100 * shared >= 80 * (size[:, None] + size - shared))) if a < b]
    change = True
    while change:
        change = False
        for a, b in links:
            low = min(label[a], label[b])
            change |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert got == {rows[i][0]: rows[label[i]][0] for i in range(len(rows))} and len(links) < len(rows)


def test_lists_in_small_blocks_give_the_same_links(documents, monkeypatch):
    rows = corpus(9, 60)
    ordinary = minhash.all_left
    seen = []

    def small(postings, nodes, sets, matches):
        monkeypatch.setattr(minhash, "BLOCK_NODES", 2)
        seen.append(1)
        return ordinary(postings, nodes, sets, matches)

    monkeypatch.setattr(minhash, "all_left", small)
    got = minhash.near_duplicates(documents(rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(minhash.brute_force(rows)) and seen


def test_chains_of_near_copies_are_one_group(documents):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(30):  # each differs from the one before in three words, the ends share little
        base[4 * d:4 * d + 3] = [f"v{d}-{i}" for i in range(3)]
        rows.append((100 - d, " ".join(base)))
    got = minhash.near_duplicates(documents(rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == Counter(minhash.brute_force(rows))
    assert got.select("component_id").distinct().count() == 1


def test_one_of_each_keeps_columns_and_rows_without_links(documents):
    text = " ".join(f"w{i}" for i in range(30))
    docs = documents([(3, text), (1, text), (2, "other words"), (None, text), (4, None)])
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 4])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_grow_by_more_links(spark):
    def table(links):
        return spark.createDataFrame(links, "u long, v long")

    first, second = [(5, 6), (6, 7), (10, 11), (20, 21)], [(7, 10), (7, 6), (30, 31), (31, 2), (21, 21)]
    got = merged(components(table(first)), table(second))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, components(table(first + second)).collect()))
    assert Counter(map(tuple, merged(components(table(first)), table([])).collect())) == Counter(map(tuple, components(table(first)).collect()))
    assert Counter(map(tuple, merged(components(table([])), table(first)).collect())) == Counter(map(tuple, components(table(first)).collect()))


BENCH = [(1, "One two THREE four five six seven, eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, "..."), (5, "one"),
         (6, "two three four five six seven eight nine ten eleven x"), (7, "short item")]


@pytest.mark.parametrize("block_words", [50_000, 11])
def test_decontamination_against_the_definition(spark, documents, block_words):
    rows = [(1, "a one two three four five six seven eight nine ten b"), (2, "a short item, and a short-item"), (3, None), (4, ""), (5, "two three four five"),
            (6, "six seven eight nine ten eleven twelve one two three four five six seven eight nine"), (7, "short\nitem"), (7, "short\nitem"), (8, "Öne two"), (None, "one")]
    rows += [(20 + i, t and t + " " + BENCH[0][1]) for i, (_, t) in enumerate(corpus(11, 20))]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontamination.contamination(documents(rows), bench, block_words=block_words).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"), F.expr("n_hit > 0").alias("c"))
    assert rows_of(got, *got.columns) == Counter(decontamination.brute_force(rows, BENCH))


def test_long_items_are_cut_and_the_driver_gets_a_block_at_a_time(spark, documents):
    long = [f"w{i}" for i in range(300)]
    bench = [(1, " ".join(long)), (2, "short item"), (3, " ".join(long[50:90]))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    sizes = [sum(len(words) for _, words in block) for block in decontamination.item_blocks(items, 60)]
    assert len(sizes) > 4 and max(sizes) <= 60
    rows = [(1, "a " + " ".join(long[20:45]) + " b"), (2, " ".join(long)), (3, "a short item"), (4, " ".join(long[296:300])), (5, " ".join(long[i] for i in range(290, 300)))]
    got = decontamination.contamination(documents(rows), items, block_words=60).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"), F.expr("n_hit > 0").alias("c"))
    assert rows_of(got, *got.columns) == Counter(decontamination.brute_force(rows, bench))


@pytest.mark.parametrize("block_words", [50_000, 11])
def test_hit_spans_are_cut_out(spark, documents, block_words):
    item = "one two three four five six seven eight nine ten"
    docs = documents([(1, f"Ünder all, {item}. And words that stay as they are, more words than were hit"), (2, item), (3, None), (4, "clean"), (None, f"é é {item}" + " é" * 30)])
    bench = spark.createDataFrame([(1, item), (2, "zzz yyy")], "item_id long, text string")
    left = decontamination.decontaminated(docs, bench, block_words=block_words)
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars if r.text else 0) for r in left.collect()} == {
        (1, "Ünder all, . And words that stay as they are, more words than were hit", 70), (3, None, 0), (4, "clean", 5), (None, "é é " + " é" * 30, 64)}
    empty = decontamination.decontaminated(docs, bench.limit(0))
    assert empty.count() == 5


def test_words_do_not_cross_rows_and_long_words_differ():
    texts = pa.array(["ab", "cd ab", None, "", "x" * 200 + " " + "x" * 199 + "y", "ab"])
    (_, _, data, offsets), = words.blocks(texts)
    w = words.Words(data, offsets)
    assert w.row.tolist() == [0, 1, 1, 4, 4, 5]
    assert w.names[0] == w.names[2] == w.names[5] and len(np.unique(w.names)) == 4
    assert w.counts().tolist() == [1, 2, 0, 0, 2, 1]


def test_empty_tables(documents):
    none = documents([])
    for run in (suffixes.dedup_bytes, substrings.dedup_windows, minhash.near_duplicates, minhash.one_of_each):
        assert run(none).collect() == []
