import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import stripes
from folioscope.operators.blocks import group_runs
from folioscope.operators.packing import chunk_arrays, explode_chunks, pack_chunks

TYPES = {"P": "paragraph", "B": "bulleted_list_item", "N": "numbered_list_item", "H1": "heading_1", "H2": "heading_2",
         "D": "divider", "I": "image", "X": "unknown_type"}
GOLDEN = [
    ("P:A:3", ["\nA"]),
    ("P:A:6 P:B:6", ["\nA\n", "B"]),
    ("D", [""]),
    ("P:A:12", ["", "A"]),
    ("H1:H:2 P:A:3", ["\nH\nA"]),
    ("H1:H1:2 H2:H2:1", ["\nH1\nH2"]),
    ("P:P:4 B:L1:4 B:L2:4", ["\nP\n", "L1\nL2"]),
    ("P:P:6 H2:H:1 B:L:5", ["\nP\n", "H\nL"]),
    ("I P:A:1", ["\n\nA"]),
    ("B:L:12", ["", "L"]),
    ("D D", ["", ""]),
    ("B:a:1 N:b:1", ["\na\nb"]),
    ("H1:H:1 D P:A:1", ["\nH", "\nA"]),
    ("P:BIG:12 I I I", ["", "BIG\n", "\n"]),
    ("P:A:5 P:B:5 P:C:1", ["\nA\n\nB\n", "C"]),
    ("P:A:6 P:B:7 B:L:5", ["\nA\n", "B\n\nL"]),
]


def rows_of(page, text):
    for pos, block in enumerate(text.split()):
        name, *rest = block.split(":")
        yield (page, pos, TYPES[name], rest[0] if rest else "", int(rest[1]) if rest else 0)


def blocks_frame(spark, pages):
    rows = [row for page, text in pages for row in rows_of(page, text)]
    return spark.createDataFrame(rows, "page_id string, pos int, btype string, text string, n_tokens bigint")


def collected(chunks):
    out = {}
    for row in sorted(chunks.collect(), key=lambda r: (r.page_id, r.chunk_id)):
        out.setdefault(row.page_id, []).append(row.text)
        assert row.chunk_id == len(out[row.page_id])
    return out


def test_golden_cases(spark):
    pages = [(f"{i:02}", text) for i, (text, _) in enumerate(GOLDEN)]
    got = collected(pack_chunks(blocks_frame(spark, pages), 10))
    assert got == {f"{i:02}": chunks for i, (_, chunks) in enumerate(GOLDEN)}


@pytest.fixture(scope="module")
def random_pages(spark):
    rng = random.Random(7)
    pages = []
    for page in range(30):
        blocks = []
        for i in range(rng.randint(1, 40)):
            name = rng.choices(list(TYPES), [6, 4, 2, 2, 2, 1, 2, 1])[0]
            blocks.append(name if name in "DIX" else f"{name}:{name}{i}:{rng.choice([0, 1, 2, 3, 5, 8, 12])}")
        pages.append((f"p{page:02}", " ".join(blocks)))
    return blocks_frame(spark, pages).cache()


@pytest.mark.parametrize("stripe_rows", [3, 16])
def test_stripes_equal_whole_pages(spark, random_pages, stripe_rows):
    assert collected(pack_chunks(random_pages, 10, stripe_rows)) == collected(pack_chunks(random_pages, 10))


def test_runs_in_stripes_equal_whole_pages(random_pages):
    whole = sorted(map(tuple, group_runs(random_pages).collect()))
    assert whole and whole == sorted(map(tuple, group_runs(random_pages, 3).collect()))


def test_drop_blank(spark):
    blocks = blocks_frame(spark, [("a", "D P:A:3 D D P:B:1"), ("b", "D P:A:3")])
    expected = {"a": ["\nA", "\nB"], "b": ["\nA"]}
    got = collected(pack_chunks(blocks, 10, drop_blank=True))
    assert {p: [c.strip() for c in cs] for p, cs in got.items()} == {p: [c.strip() for c in cs] for p, cs in expected.items()}
    assert collected(pack_chunks(blocks, 10, 2, drop_blank=True)) == got


def test_kept_text_is_whole_and_bounded(random_pages):
    got = collected(pack_chunks(random_pages, 10))
    kept = {}
    for row in sorted(random_pages.collect(), key=lambda r: (r.page_id, r.pos)):
        if row.btype not in ("divider", "image", "unknown_type"):
            kept.setdefault(row.page_id, []).append(row.text)
    for page, texts in kept.items():
        assert [line for chunk in got[page] for line in chunk.split("\n") if line] == texts


def test_arrays_and_explode(spark, random_pages):
    arrays = chunk_arrays(random_pages, 10)
    assert {r.page_id: r.chunks for r in arrays.collect()} == collected(pack_chunks(random_pages, 10))
    assert {r.page_id: r.chunks for r in chunk_arrays(random_pages, 10, 4).collect()} == {r.page_id: r.chunks for r in arrays.collect()}
    rows = explode_chunks(spark.createDataFrame([("d", ["x", "y"], "t")], "id string, chunks array<string>, title string")).collect()
    assert [(r.id, r.doc_id, r.chunk_id, r.title, r.document) for r in rows] == [("d_1", "d", 1, "t", "x"), ("d_2", "d", 2, "t", "y")]


def chunks_of_sizes(spark, page, sizes, types=None):
    rows = [(page, i, (types or ["paragraph"] * len(sizes))[i], f"{page}{i}", n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "page_id string, pos int, btype string, text string, n_tokens bigint")


@pytest.mark.parametrize("n", [8, 64])
def test_rounds_grow_with_the_logarithm_of_the_stripes(spark, monkeypatch, n):
    """Blocks of even size, whose chunk borders never meet between stripes."""
    blocks = chunks_of_sizes(spark, "p", [3] * (7 * n))
    rounds, compose = [], stripes._compose
    monkeypatch.setattr(stripes, "_compose", lambda *a: rounds.append(1) or compose(*a))
    assert collected(pack_chunks(blocks, 10, 7)) == collected(pack_chunks(blocks, 10))
    assert len(rounds) <= math.ceil(math.log2(n)) + 3


def test_states_that_pass_through_whole_stripes(spark):
    sizes = [4, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 6, 0, 0, 0, 0, 0, 12, 0, 0, 3, 9, 2]
    kinds = ["bulleted_list_item" if i % 5 == 3 else "paragraph" for i in range(len(sizes))]
    blocks = chunks_of_sizes(spark, "p", sizes, kinds)
    assert collected(pack_chunks(blocks, 10, 2)) == collected(pack_chunks(blocks, 10))


def test_a_page_of_100_000_blocks(spark):
    n = 100_000
    blocks = spark.range(n).select(F.lit("p").alias("page_id"), F.col("id").cast("int").alias("pos"), F.lit("paragraph").alias("btype"),
                                   F.concat(F.lit("t"), "id").alias("text"), F.lit(100).cast("bigint").alias("n_tokens"))
    got = pack_chunks(blocks, 1024).orderBy("chunk_id").collect()
    # Ten blocks a chunk; before every block that follows no run stands an empty line.
    assert [r.chunk_id for r in got] == list(range(1, n // 10 + 1))
    assert [t for r in got for t in r.text.split("\n") if t] == [f"t{i}" for i in range(n)]
    assert all(sum(t != "" for t in r.text.split("\n")) == 10 for r in got)


def one_by_one(ops, sizes, entry, max_tokens):
    """Places that open a chunk and the end state, an operation after the other."""
    tokens, items, last, starts = entry[0], entry[1], 0, []
    for i, (op, size) in enumerate(zip(ops, sizes)):
        if op == "B":
            tokens = items = 0
            continue
        over = tokens + size > max_tokens
        if items == 0 or over and (op == "C" or size > tokens or tokens == 0):
            starts.append(i)
            tokens, items = size, 1
        elif over and items > 2:
            starts.append(i - 1)
            tokens, items = last + size, 2
        else:
            tokens, items = tokens + size, items + 1
        last = size
    return starts, (tokens, min(items, 3))


@pytest.mark.parametrize("seed", range(4))
def test_chains_against_one_operation_after_the_other(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(1, 40)
        ops = [rng.choice("FFFCCB"[:rng.choice([3, 5, 6])]) for _ in range(n)]
        sizes = [0 if op == "B" else rng.choice([0, 0, 1, 2, 3, 5, 8, 12]) for op in ops]
        chains = stripes.Chains(np.array(ops, object), np.array(sizes), 0, 10)
        for entry in [(0, 0), (3, 1), (7, 2), (9, 3), (14, 1)]:
            starts, end = one_by_one(ops, sizes, entry, 10)
            assert chains.starts(np.array(entry)).tolist() == starts
            assert tuple(chains.exits(np.array([entry]))[1][0]) == end
