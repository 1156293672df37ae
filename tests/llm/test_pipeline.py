"""The pipeline against a plain Python version of every stage, over the smallest given tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from folioscope.llm import decontamination, minhash, packing, quality
from tests.llm.test_operators import plain_ids

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def good(docs: dict[int, str]) -> dict[int, str]:
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(docs.items()))
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    return {d: t for d, t in docs.items() if d in kept}


def without_lines(docs: dict[int, str]) -> dict[int, str]:
    def key(line: str) -> str:
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    holders = defaultdict(set)
    for d, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs.items():
        lines = t.split("\n")
        left = [x for x in lines if not (len(holders[key(x)]) >= 5 and max(holders[key(x)]) != d)]
        if len(left) == len(lines) or "\n".join(left).strip(WHITE):
            out[d] = "\n".join(left)
    return out


def first_of_each(docs: dict[int, str]) -> dict[int, str]:
    return {d: docs[d] for d, _, _, kept in minhash.brute_force(list(docs.items()), 5) if kept}


def clean(docs: dict[int, str], benchmark: list[tuple]) -> dict[int, str]:
    windows = set()
    for _, text in benchmark:
        w = ALNUM.findall((text or "").encode().lower())
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.add(tuple(w[i:i + 10]))
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in docs.items():
        raw = t.encode()
        at = [(m.start(), m.end(), m.group()) for m in ALNUM.finditer(raw.lower())]
        hit = [False] * len(at)
        for n in lengths:
            for i in range(len(at) - n + 1):
                if tuple(x[2] for x in at[i:i + n]) in windows:
                    hit[i:i + n] = [True] * n
        if sum(hit) * 100 > 50 * len(at):
            continue
        text, done = b"", 0
        for i, h in enumerate(hit):
            if h and (i == 0 or not hit[i - 1]):
                text += raw[done:at[i][0]]
            if h:
                done = at[i][1]
        out[d] = (text + raw[done:]).decode()
    return out


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    return (dict(con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()), con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())


def test_stages_against_plain_python(spark, tables):
    docs, benchmark = tables
    plain = [good, without_lines, first_of_each, lambda d: clean(d, benchmark)]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns = df.columns
    for (name, stage), same in zip(corpus_pipeline.STAGES, plain):
        before, docs = docs, same(docs)
        df = corpus_pipeline.materialize(stage(spark, df, SF), name)
        assert df.columns == columns, name
        assert {r.doc_id: r.text for r in df.collect()} == docs, name
        assert all(r.n_chars == len(r.text) for r in df.collect())
        assert docs != before, f"{name} changes nothing here"
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({d: len(plain_ids(t)) + 1 for d, t in docs.items()})


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and got.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "pack"]


def test_stages_take_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "the of and a to in is it " * 20), (None, "the of and a to in is it " * 20), (4, "x" * 3000), (4, "x" * 3000)]
    for docs in (documents(rows), documents([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
