"""The byte-level network: gradients, coverage of whole texts, and held-out accuracy over the given documents."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import classifier

LABELS = "doc_id long, quality int, toxic int"


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 960, 961, 5_000])
def test_chunks_cover_the_text_and_overlap(n):
    text = (np.arange(n) % 255 + 1).astype(np.uint8)
    rows = classifier.chunks(text)
    step = classifier.CHUNK - classifier.OVERLAP
    seen = np.zeros((len(rows) - 1) * step + classifier.CHUNK, np.uint8)
    for i, row in enumerate(rows):
        seen[i * step:i * step + classifier.CHUNK] = row
    assert (seen[:n] == text).all() and not seen[n:].any()
    assert len(rows) == 1 or (len(rows) - 1) * step < n


def test_gradients_against_differences():
    rng = random.Random(1)
    texts = [as_bytes("".join(rng.choice("abc &#") for _ in range(size))) for size in (30, 700, 0)]
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])
    network = classifier.Network.new(3)
    network.weights = {n: w.astype(np.float64) for n, w in network.weights.items()}
    network.weights["top"] *= 10

    def loss() -> float:
        p = network.probabilities(texts)
        return float((weight * -np.where(labels == 1, np.log(p), np.log(1 - p))).mean())

    gradient = network.gradients(texts, labels, weight)
    for name, w in network.weights.items():
        for place in rng.sample(range(w.size), min(6, w.size)) + ([ord("&") * classifier.BYTE_DIM] if name == "bytes" else []):
            flat, step = w.reshape(-1), 1e-5
            before = flat[place]
            flat[place] = before + step
            up = loss()
            flat[place] = before - step
            down = loss()
            flat[place] = before
            assert abs((up - down) / (2 * step) - gradient[name].reshape(-1)[place]) < 2e-4, name


def test_score_depends_on_the_last_byte_of_a_long_text():
    network = classifier.Network.new(4)
    network.weights["top"] *= 20
    plain = as_bytes("a" * 3_000_000)
    odd = as_bytes("a" * 2_999_990 + "#$&!%&*#!?")
    assert network.probability(plain) != network.probability(odd)
    assert network.probabilities([odd, as_bytes("")])[0] == network.probability(odd)


def test_texts_that_share_a_pass_have_the_score_they_have_alone():
    rng = random.Random(5)
    network = classifier.Network.new(6)
    texts = [as_bytes("".join(rng.choice("ab c#") for _ in range(rng.randrange(0, 9_000)))) for _ in range(60)] + [as_bytes("x" * 200_000)]
    assert np.allclose(network.probabilities(texts), [network.probability(t) for t in texts], atol=1e-6)


def junk(rng: random.Random, bad: bool) -> str:
    words = ["the", "of", "reading", "house", "and", "water"]
    return " ".join(rng.choice(words) + (rng.choice(["###", "&&", "%%%"]) if bad and rng.random() < 0.3 else "") for _ in range(rng.randrange(20, 200)))


def test_fit_and_score(spark, documents):
    rng = random.Random(7)
    rows = [(d, junk(rng, d % 4 == 0)) for d in range(400)] + [(None, "the house"), (1_000, None), (1_001, ""), (5, None), (3, "the house")]
    labels = [(d, int(d % 4 != 0), 0) for d in range(400)] + [(None, 1, 0), (6, None, 1), (9, 0, 0), (1_000, 1, None)]
    docs = documents(rows)
    known = {r.doc_id for r in classifier.known_labels(spark.createDataFrame(labels, LABELS)).collect()}
    assert known == {d for d in [*range(400), 1_000] if zlib.crc32(str(d).encode()) % 3 != 1} - {9}
    network = classifier.fit(docs, spark.createDataFrame(labels, LABELS), rows=100)
    again = classifier.fit(docs.repartition(2), spark.createDataFrame(labels, LABELS).repartition(4), rows=100)
    assert np.allclose(network.flat(), again.flat(), atol=1e-3)
    got = classifier.scored(docs, network, "doc_id", "row", "n_words").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and {r.n_words for r in got} == {"x"}
    held = [r for r in got if r.doc_id is not None and 10 < r.doc_id < 400 and r.doc_id not in known]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(2, 1, 0), (3, 1, 0)], 1.0), ([(2, 0, 0), (3, 0, 0)], 0.0), ([(2, None, 0)], 0.5)])
def test_fit_without_two_labels(spark, documents, labels, score):
    docs = documents([(d, "some text") for d in range(5)])
    network = classifier.fit(docs, spark.createDataFrame(labels, LABELS), may_learn=lambda d: F.lit(True))
    assert all(abs(r.score - score) < 1e-5 for r in classifier.scored(docs, network, "doc_id").collect())


def test_fit_where_no_text_may_be_learned_from(spark, documents):
    network = classifier.fit(documents([(1, None)]), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS), may_learn=lambda d: F.lit(True))
    assert abs(network.probability(as_bytes("x")) - 0.5) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = classifier.op12_byte_convolution(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (got.predicted == got.quality).mean() > 0.93
    assert np.mean([(good > b).mean() for b in bad]) > 0.97


def test_empty_tables(spark, tmp_path, documents):
    documents([]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert not classifier.op12_byte_convolution(spark, str(tmp_path)).collect()
