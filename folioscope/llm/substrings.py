"""Substring dedup by level-wise doubling: word windows that repeat at one length alone are extended to twice that length.

Level 1 looks at windows of half the length. Not every one is posted: each full window has one smallest half-length
window by hash, and those suffice, since equal full windows have it at the same place. Level 2 forms the full windows
whose level-1 window is in two documents at least, each named by the names of its two halves, and of equal ones all but
those of the smallest doc_id are removed. Nothing else survives to be extended.

Level 1 is a count that is combined in the map tasks, so a passage of a third of all documents arrives reduced, and a join
Spark may split. In level 2 windows under a level-1 window of more than ``HOT_ROWS`` rows take that way again; all others
are compared within groups of bounded size. Names of level 2 have 128 bits. Texts move twice, to meet the
positions found in them; only documents with a repeated level-1 window are looked at in level 2.

Null text is empty. Rows without a doc_id neither lose words nor take any from others. Rows that repeat a doc_id do not
take words from each other. Overlapping windows are all removed, judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioscope.llm.store import materialize, table
from folioscope.llm.words import Words, blocks, mix, pair, signed, smallest, window_names

WINDOW = 50
HOT_ROWS = 100_000
_SECOND = np.uint64(0xA0761D6478BD642F)


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the full windows of each row, where the smallest half-length window of each begins, names of all of those."""
    half = (window + 1) // 2
    names = window_names(w.names, half)
    n = len(w.names) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), names
    starts = np.flatnonzero(w.row[:n] == w.row[window - 1:])
    return starts, smallest_of(names, window - half + 1)[starts], names


def smallest_of(names: np.ndarray, w: int, piece: int = 1 << 22) -> np.ndarray:
    """``smallest`` over any number of names."""
    n = len(names) - w + 1
    return np.concatenate([smallest(names[lo:min(lo + piece, n) + w - 1], w) + lo for lo in range(0, n, piece)]) if n > 0 else np.zeros(0, np.int64)


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def posted(docs: DataFrame, window: int) -> DataFrame:
    """Level 1: name, doc_id, text hash and word position of the half-length windows that are looked at."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                w = Words(data, offsets)
                _, at, names = _anchors(w, window)
                at = _distinct(at)
                rows = pa.array(w.row[at] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(names[at])), batch.column("doc_id").take(rows), batch.column("_text").take(rows), pa.array((at - w.first()[w.row[at]]).astype(np.int32))],
                    names=["name", "doc_id", "_text", "pos"])

    return docs.mapInArrow(post, "name long, doc_id long, _text long, pos int")


def repeated(posts: DataFrame, hot_rows: int) -> DataFrame:
    """Names that two documents hold, with a mark on those of very many rows."""
    return (
        posts.groupBy("name").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count("*").alias("_n"))
        .where("_low < _high").select("name", (F.col("_n") > hot_rows).alias("hot")))


def candidates(docs: DataFrame, window: int, hot_rows: int) -> DataFrame:
    """Level 2: both names, doc_id, text hash, word position and mark of every full window that may repeat."""
    posts = posted(docs, window)
    place = (F.col("pos") * 2 + F.col("hot").cast("int")).alias("p")
    found = materialize(
        posts.join(materialize(repeated(posts, hot_rows), "repeated-names"), "name").groupBy("doc_id", "_text").agg(F.collect_set(place).alias("found")), "repeated-halves")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (window + 1) // 2
        for batch in batches:
            lists = batch.column("found")
            for lo, hi, data, offsets in blocks(batch.column("text")):
                w = Words(data, offsets)
                starts, at, names = _anchors(w, window)
                own = lists.slice(lo, hi - lo)
                places = own.flatten().to_numpy()
                row = np.repeat(np.arange(hi - lo), np.diff(own.offsets.to_numpy()))
                mark = np.zeros(len(w.names) + 1, np.int8)
                mark[np.minimum(w.first()[row] + (places >> 1), len(w.names))] = 1 + (places & 1)
                keep = np.flatnonzero(mark[at])
                s, heat = starts[keep], mark[at[keep]] == 2
                other = window_names(mix(w.names ^ _SECOND), half)
                n1, n2 = (pair(x[s], x[s + window - half]) for x in (names, other))
                rows = pa.array(w.row[s] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(n1)), pa.array(signed(n2)), batch.column("doc_id").take(rows), batch.column("_text").take(rows),
                     pa.array((s - w.first()[w.row[s]]).astype(np.int32)), pa.array(heat)],
                    names=["n1", "n2", "doc_id", "_text", "pos", "hot"])

    return docs.join(found, ["doc_id", "_text"]).select("doc_id", "_text", "text", "found").mapInArrow(
        extend, "n1 long, n2 long, doc_id long, _text long, pos int, hot boolean")


def later_copies(windows: DataFrame) -> DataFrame:
    """Rows of ``windows`` whose name a smaller doc_id has too. Hot ones are reduced before they meet."""
    cold = windows.where("not hot").withColumn("_first", F.min("doc_id").over(Window.partitionBy("n1", "n2")))
    hot = windows.where("hot")
    firsts = materialize(hot.groupBy("n1", "n2").agg(F.min("doc_id").alias("_first")), "hot-windows")
    rows = cold.unionByName(hot.join(firsts, ["n1", "n2"]))
    return rows.where(F.col("doc_id") > F.col("_first")).select("doc_id", "_text", "pos")


def dedup_windows(docs: DataFrame, window: int = WINDOW, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (words left, joined by one blank) for every row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    cut = materialize(
        later_copies(candidates(rows.where("doc_id is not null"), window, hot_rows)).groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("cut")), "later-copies")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cut")
            for lo, hi, data, offsets in blocks(batch.column("text")):
                w = Words(data, offsets)
                first, counts = w.first(), w.counts()
                own = lists.slice(lo, hi - lo)
                removed, kept = [], []
                for r in range(hi - lo):
                    gone = np.zeros(counts[r] + 1, np.int64)
                    if own[r].is_valid:
                        at = own.values[own.offsets[r].as_py():own.offsets[r + 1].as_py()].to_numpy()
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + first[r]
                    kept.append(b" ".join([data[a:b].tobytes() for a, b in zip(w.start[stays].tolist(), w.end[stays].tolist())]))
                    removed.append(int(counts[r]) - len(stays))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(cut, ["doc_id", "_text"], "left").select("doc_id", "text", "cut").mapInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_windows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same rows from the definition, for tests."""
    import re

    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    low: dict[tuple, int] = {}
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i:i + window])
            low[key] = min(low.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if low[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
