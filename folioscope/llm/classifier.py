"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover it from end to end: ``CHUNK`` bytes each, the next begins
``CHUNK - OVERLAP`` bytes on, the last is filled up with zero bytes. In a chunk every ``STRIDE`` bytes a window of
``WIDTH`` learned byte vectors meets ``FILTERS`` learned filters, and each filter keeps its largest answer (rectified). The
largest and the mean of these over all chunks, through one logistic layer, are the probability that the quality label is 1.

The network is fitted in one Spark task on a bounded sample of labelled rows, at most ``FIT_ROWS`` of each label, by hash of
the doc_id and each of at most ``FIT_TEXT_BYTES``; the two labels are weighted by how often they occur among all rows that may
be learned from. The weights are stored, and every text is scored whole, a bounded piece at a time, in the tasks that read it;
no row moves. Rows that take part in the fit are chosen by ``learnable`` (for the query: crc32 of the doc_id is not 1 modulo 3), and only the text is an input.

Null or empty text is one chunk of zero bytes and has a score too. A null doc_id is not held out and not learned from.
Labels that are null, or that contradict each other for one doc_id, are not learned from; of texts that share a doc_id the smallest is.
With only one label, or none, there is nothing to fit: every score is the share of label 1, 0.5 without labels. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.llm.store import materialize, table
from folioscope.llm.words import blocks

CHUNK = 512
OVERLAP = 64
WIDTH = 8
STRIDE = 4
BYTE_DIM = 8
FILTERS = 24
#: Bounds of the sample the network is fitted on: rows of each label, and bytes of a text.
FIT_ROWS = 2_000
FIT_TEXT_BYTES = 16_384
#: The sample is gone through ``EPOCHS`` times, a small one as often as ``LEAST_STEPS`` batches take.
EPOCHS = 14
LEAST_STEPS = 700
BATCH_TEXTS = 32
RATE = 0.004
DECAY = 1e-4
SEED = 20_240_101
#: Chunks that are scored at once.
CHUNKS_AT_ONCE = 256
SHAPES = {"bytes": (256, BYTE_DIM), "filters": (WIDTH * BYTE_DIM, FILTERS), "filter_bias": (FILTERS,), "top": (2 * FILTERS,), "top_bias": (1,)}


def chunks(text: np.ndarray) -> np.ndarray:
    """Bytes of a text as rows of overlapping chunks; one row of zeros for an empty text."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[:len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = SEED) -> Network:
        draw = np.random.default_rng(seed)
        scale = {"bytes": 0.5, "filters": (WIDTH * BYTE_DIM) ** -0.5, "filter_bias": 0.0, "top": 0.1, "top_bias": 0.0}
        return cls({name: (draw.standard_normal(shape) * scale[name]).astype(np.float32) for name, shape in SHAPES.items()})

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Network:
        ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
        parts = np.split(np.asarray(flat, np.float32), ends[:-1])
        return cls({name: part.reshape(shape) for (name, shape), part in zip(SHAPES.items(), parts)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[name].ravel() for name in SHAPES])

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        """Chunks -> the byte vectors of every window: chunk, place, WIDTH * BYTE_DIM."""
        vectors = self.weights["bytes"][rows].reshape(len(rows), -1)
        view = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * BYTE_DIM, axis=1)
        return view[:, ::STRIDE * BYTE_DIM]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of every filter in every chunk, rectified, and the place it is at."""
        windows = self._windows(rows)
        n, places, size = windows.shape
        answers = (np.ascontiguousarray(windows).reshape(-1, size) @ self.weights["filters"]).reshape(n, places, -1)
        at = answers.argmax(axis=1)
        best = np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + self.weights["filter_bias"]
        return np.maximum(best, 0), at

    def probability(self, text: np.ndarray) -> float:
        """Of one whole text; memory holds ``CHUNKS_AT_ONCE`` chunks of it."""
        rows = chunks(text)
        most, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
        for lo in range(0, len(rows), CHUNKS_AT_ONCE):
            answers, _ = self.pooled(rows[lo:lo + CHUNKS_AT_ONCE])
            most = np.maximum(most, answers.max(axis=0))
            total += answers.sum(axis=0)
        return float(self._top(np.concatenate([most, total / len(rows)])[None])[0])

    def probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """The same for several texts; short ones share a pass."""
        out = np.empty(len(texts))
        cut = [chunks(t) if len(t) <= CHUNKS_AT_ONCE * (CHUNK - OVERLAP) else None for t in texts]
        waiting: list[int] = []
        for i, rows in enumerate([*cut, None]):
            full = waiting and (i == len(texts) or sum(len(cut[j]) for j in waiting) + (0 if rows is None else len(rows)) > CHUNKS_AT_ONCE)
            if full:
                answers, _ = self.pooled(np.concatenate([cut[j] for j in waiting]))
                starts = np.cumsum([0, *(len(cut[j]) for j in waiting[:-1])])
                size = np.array([len(cut[j]) for j in waiting])[:, None]
                out[waiting] = self._top(np.concatenate([np.maximum.reduceat(answers, starts), np.add.reduceat(answers.astype(np.float64), starts) / size], axis=1))
                waiting = []
            if i == len(texts):
                break
            if rows is None:
                out[i] = self.probability(texts[i])
            else:
                waiting.append(i)
        return out

    def _top(self, features: np.ndarray) -> np.ndarray:
        z = features.astype(np.float64) @ self.weights["top"].astype(np.float64) + float(self.weights["top_bias"][0])
        return np.exp(-np.logaddexp(0, -z))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss. Pooling passes them to the places of the largest answers only."""
        rows = [chunks(t) for t in texts]
        size = np.array([len(r) for r in rows])
        rows, starts = np.concatenate(rows), np.cumsum(np.append(0, size[:-1]))
        owner = np.repeat(np.arange(len(texts)), size)
        answers, at = self.pooled(rows)
        most, mean = np.maximum.reduceat(answers, starts), np.add.reduceat(answers, starts) / size[:, None]
        features = np.concatenate([most, mean], axis=1)
        d = ((self._top(features) - labels) * weight / len(texts)).astype(np.float32)
        d_features = d[:, None] * self.weights["top"]
        is_most = answers == most[owner]
        share = is_most / np.maximum(np.add.reduceat(is_most.astype(np.float32), starts), 1)[owner]
        d_answers = (d_features[owner, :FILTERS] * share + d_features[owner, FILTERS:] / size[owner, None]) * (answers > 0)
        d_answers = d_answers.astype(np.float32)
        windows = self._windows(rows)
        picked = windows[np.arange(len(rows))[:, None], at]  # chunk, filter, WIDTH * BYTE_DIM
        d_filters = np.einsum("cfw,cf->wf", picked, d_answers)
        d_picked = (d_answers[:, :, None] * self.weights["filters"].T).reshape(-1, WIDTH, BYTE_DIM)
        where = (at[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(len(rows), -1)
        letters = np.take_along_axis(rows, where, axis=1).ravel()
        d_bytes = np.stack([np.bincount(letters, d_picked[:, :, k].ravel(), 256) for k in range(BYTE_DIM)], axis=1)
        return {"bytes": d_bytes, "filters": d_filters, "filter_bias": d_answers.sum(axis=0), "top": features.T @ d, "top_bias": d.sum(keepdims=True)}


def train(texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over shuffled batches, the rate falling to nothing; the same sample gives the same network."""
    network, draw = Network.new(seed), np.random.default_rng(seed + 1)
    first = {n: np.zeros(s) for n, s in SHAPES.items()}
    second = {n: np.zeros(s) for n, s in SHAPES.items()}
    batches = -(-len(texts) // BATCH_TEXTS)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for lo in range(0, len(order), BATCH_TEXTS):
            own = order[lo:lo + BATCH_TEXTS]
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for name, g in network.gradients([texts[i] for i in own], labels[own], weight[own]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                network.weights[name] = ((1 - rate * DECAY) * network.weights[name] - rate * change).astype(np.float32)
    return network


# Spark


def learnable(doc_id: Column) -> Column:
    """Rows that labels are learned from: the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def known_labels(labels: DataFrame, may_learn=learnable) -> DataFrame:
    """doc_id, quality of the rows that may be learned from and agree about their document."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & may_learn(F.col("doc_id")))
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    return agreed.where("quality = _most").select("doc_id", "quality")


def fit_sample(docs: DataFrame, known: DataFrame, rows: int = FIT_ROWS, text_bytes: int = FIT_TEXT_BYTES) -> DataFrame:
    """doc_id, quality, text: at most ``rows`` of each label, chosen by hash of the doc_id."""
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    chosen = materialize(chosen[0].unionByName(chosen[1]), "fit-labels")  # at most 2 * rows rows
    near = docs.where(F.octet_length("text") <= text_bytes).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return near.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, may_learn=learnable, rows: int = FIT_ROWS, text_bytes: int = FIT_TEXT_BYTES, epochs: int = EPOCHS) -> Network:
    """The network for all learnable rows, from a bounded sample of them."""
    known = materialize(known_labels(labels, may_learn), "known-labels")
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    good = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return _constant(good if counts else 0.5)
    sample = materialize(fit_sample(docs, known, rows, text_bytes), "fit-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(d, q, t) for batch in batches for d, q, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "text")))]
        held.sort()
        texts = [np.frombuffer(t.encode(), np.uint8) for _, _, t in held]
        y = np.array([q for _, q, _ in held], np.float64)
        if len(set(y.tolist())) == 2:
            share = np.where(y == 1, good / y.mean(), (1 - good) / (1 - y.mean()))
            network = train(texts, y, share, epochs)
        else:
            network = _constant(good)
        yield pa.RecordBatch.from_arrays([pa.array([network.flat()], pa.list_(pa.float32()))], names=["weights"])

    # One task learns; a lost executor repeats it and comes to the same weights.
    weights = materialize(sample.repartition(1).mapInArrow(learn, "weights array<float>"), "weights").first()
    return Network.from_flat(np.array(weights.weights)) if weights else _constant(good)


def _constant(probability: float) -> Network:
    network = Network.new()
    p = min(max(probability, 1e-6), 1 - 1e-6)
    network.weights["top"] = np.zeros(2 * FILTERS, np.float32)
    network.weights["top_bias"] = np.array([np.log(p / (1 - p))], np.float32)
    return network


def scored(docs: DataFrame, network: Network, *keep: str) -> DataFrame:
    """``keep`` columns and the score of every whole text."""
    flat = network.flat()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.from_flat(flat)
        for batch in batches:
            out = [own.probabilities([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) for _, _, data, offsets in blocks(batch.column("_text"))]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*keep, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(score, f"{fields}, score double")


def op12_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs, network, "doc_id")
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
