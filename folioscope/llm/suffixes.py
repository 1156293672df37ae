"""Suffix-array dedup by distributed prefix doubling: (rank, position) rows are sorted by Spark at growing lengths, a suffix
whose prefix is unique drops out, and at the threshold length equal prefixes are repeated passages.

A rank is a name: a hash of the prefix, so that equal prefixes have equal ranks in every task without a global numbering,
and the rank of 2h bytes is made of the ranks of h bytes at i and at i + h (8, 16, 32 and, overlapping, the threshold).

* Length 16. Every passage of threshold length holds one smallest 16-byte prefix by hash, at the same place in every copy,
  so only those suffixes are ranked: about one in eighteen. The count per rank is combined in the map tasks; ranks of a single
  document drop out, and a join that Spark may split brings back the others.
* Threshold length. Each suffix left stands for the run of passages whose smallest prefix it is. That run's bytes are sorted by
  Spark by (16-byte rank, bytes, doc_id), and a task walks through the groups: equal runs are copies, and the passages of
  unequal ones are ranked at the threshold length among each other.

A 16-byte rank of more than ``HOT_ROWS`` suffixes is not walked through by one task: its passages become rows of 128-bit ranks,
counted and joined like the first length. Texts longer than ``LONG_BYTES`` are ranked in overlapping pieces.

Null text is empty. Rows without a doc_id neither lose bytes nor take any from others. Rows that repeat a doc_id do not take
bytes from each other. Matches never cross documents; overlaps are all removed, judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm.store import materialize, table
from folioscope.llm.words import BLOCK_BYTES, blocks, mix, pair, signed, smallest

WINDOW = 50
PREFIX = 16
HOT_ROWS = 100_000
LONG_BYTES = 1 << 22
CHUNK_BYTES = 1 << 20
_SECOND = np.uint64(0xA0761D6478BD642F)
SPAN = "doc_id long, _text long, start int, stop int"


def ranks(data: np.ndarray, length: int, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Rank of the ``length`` bytes from every position on, by doubling; ``length`` is 8 at least."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = data.astype(np.uint16)
    b = (b[:-1] | (b[1:] << np.uint16(8))).astype(np.uint32)
    b = (b[:-2] | (b[2:] << np.uint32(16))).astype(np.uint64)
    rank, h = b[:-4] | (b[4:] << np.uint64(32)), 8
    if seed:
        rank = mix(rank ^ seed)
    while h < length:
        step = min(h, length - h)
        rank = pair(rank[:len(rank) - step], rank[step:])
        h += step
    return rank


def _runs(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each ranked suffix: its rank and position, and the first and last start of the passages it stands for."""
    n = len(data) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    rank = ranks(data, PREFIX)
    at = smallest(rank, window - PREFIX + 1)
    for end in offsets[1:-1].tolist():  # passages that would reach into the next text
        at[max(0, end - window + 1):end] = -1
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(edge[1:], n) - 1
    real = at[edge] >= 0
    at = at[edge][real]
    return rank[at], at, edge[real], last[real]


def _pieces(texts: pa.Array, window: int, long_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """``blocks`` with long texts in pieces that overlap by one passage less one byte; the last value is where a piece starts."""
    for lo, hi, data, offsets in blocks(texts, min(BLOCK_BYTES, long_bytes)):
        if len(data) <= long_bytes:
            yield lo, hi, data, offsets, 0
            continue
        # A block beyond its size holds one text alone.
        for start in range(0, len(data) - window + 1, long_bytes):
            part = data[start:start + long_bytes + window - 1]
            yield lo, hi, part, np.array([0, len(part)]), start


def ranked(docs: DataFrame, window: int, long_bytes: int = LONG_BYTES) -> DataFrame:
    """rank, doc_id, text hash and position of the suffixes looked at."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets, shift in _pieces(batch.column("text"), window, long_bytes):
                names, at, _, _ = _runs(data, offsets, window)
                row = np.searchsorted(offsets, at, side="right") - 1
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(names)), batch.column("doc_id").take(rows), batch.column("_text").take(rows), pa.array((at - offsets[row] + shift).astype(np.int32))],
                    names=["rank", "doc_id", "_text", "pos"])

    return docs.mapInArrow(rank, "rank long, doc_id long, _text long, pos int")


def not_unique(suffixes: DataFrame, hot_rows: int) -> DataFrame:
    return (
        suffixes.groupBy("rank").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count("*").alias("_n"))
        .where("_low < _high").select("rank", (F.col("_n") > hot_rows).alias("hot")))


def passages(docs: DataFrame, window: int, hot_rows: int, long_bytes: int = LONG_BYTES) -> tuple[DataFrame, DataFrame]:
    """doc_id, text hash, place and bytes of the runs of passages whose 16-byte rank is in two documents, those of hot ranks apart.

    ``place`` is the start of the run times ``window`` and where in it the ranked bytes begin: a rank is not stored beside its bytes.
    """
    suffixes = ranked(docs, window, long_bytes)
    place = (F.col("pos") * 2 + F.col("hot").cast("int")).alias("p")
    found = materialize(
        suffixes.join(materialize(not_unique(suffixes, hot_rows), "repeated-ranks"), "rank").groupBy("doc_id", "_text").agg(F.collect_set(place).alias("found")), "repeated-prefixes")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            for lo, hi, data, offsets, shift in _pieces(batch.column("text"), window, long_bytes):
                _, at, first, last = _runs(data, offsets, window)
                own = lists.slice(lo, hi - lo)
                places = own.flatten().to_numpy()
                row = np.repeat(np.arange(hi - lo), np.diff(own.offsets.to_numpy()))
                position = offsets[row] + (places >> 1) - shift
                inside = (position >= 0) & (position < len(data))
                mark = np.zeros(len(data), np.int8)
                mark[position[inside]] = 1 + (places[inside] & 1)
                keep = np.flatnonzero(mark[at])
                row = np.searchsorted(offsets, at[keep], side="right") - 1
                rows = pa.array(row + lo)
                flat = data.tobytes()
                runs = [flat[a:b + window] for a, b in zip(first[keep].tolist(), last[keep].tolist())]
                begin = first[keep] - offsets[row] + shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark[at[keep]] == 2), batch.column("doc_id").take(rows), batch.column("_text").take(rows),
                     pa.array(begin * window + (at[keep] - first[keep])), pa.array(runs, pa.binary())],
                    names=["hot", "doc_id", "_text", "place", "run"])

    def runs_of(hot: bool) -> DataFrame:
        held = found.where(F.exists("found", lambda p: p % 2 == int(hot)))  # other texts have none
        texts = docs.join(held, ["doc_id", "_text"]).select("doc_id", "_text", "text", "found")
        rows = texts.mapInArrow(extend, "hot boolean, doc_id long, _text long, place long, run binary")
        return rows.where(F.col("hot") == hot).drop("hot")

    return runs_of(False), runs_of(True)


def _spans_of(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Spans to remove in whole groups of rows sorted by (rank, run, doc_id)."""
    rank, doc = rows.column("rank").to_numpy(), rows.column("doc_id").to_numpy()
    start = rows.column("place").to_numpy() // window
    runs = rows.column("run").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(runs.buffers()[1], np.int64)[runs.offset:runs.offset + len(runs) + 1]
    data = np.frombuffer(runs.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    values = runs.to_pylist()
    new = np.array([True, *(a != b for a, b in zip(values, values[1:]))]) | np.concatenate([[True], rank[1:] != rank[:-1]])
    kind = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    first = doc[lead]  # the smallest doc_id of each distinct run, as rows are sorted
    later = np.flatnonzero(doc > first[kind])
    # Passages of the distinct runs, ranked among those of the same 16-byte rank.
    groups = np.cumsum(np.concatenate([[True], rank[lead][1:] != rank[lead][:-1]])) - 1
    several = np.flatnonzero(np.bincount(groups)[groups] > 1)
    out_row, out_a, out_b = [later], [start[later]], [start[later] + size[later]]
    if len(several):
        chosen = lead[several]
        width = size[chosen]
        index = np.repeat(offsets[chosen] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        bounds = np.concatenate([[0], np.cumsum(width)])
        count = width - window + 1
        owner = np.repeat(np.arange(len(chosen)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        name = pair(ranks(data[index], window)[bounds[owner] + at], rank[chosen][owner].view(np.uint64))
        order = np.argsort(name, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        low = np.minimum.reduceat(first[several][owner][order], begins)
        smaller = np.empty(len(name), bool)
        smaller[order] = np.repeat(low, np.diff(np.append(begins, len(name)))) < first[several][owner][order]
        hit = np.flatnonzero(smaller)
        if len(hit):
            cut = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
            a = hit[cut]
            b = hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
            # Every row of the run that is in its smallest document.
            ends = np.append(lead[1:], len(doc))
            of = several[owner[a]]
            n = np.array([np.searchsorted(doc[lead[k]:ends[k]], first[k], side="right") for k in of])
            which = np.repeat(np.arange(len(a)), n)
            row = np.repeat(lead[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out_row.append(row)
            out_a.append(start[row] + at[a][which])
            out_b.append(start[row] + at[b][which] + window)
    row = pa.array(np.concatenate(out_row))
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").combine_chunks().take(row), rows.column("_text").combine_chunks().take(row),
         pa.array(np.concatenate(out_a).astype(np.int32)), pa.array(np.concatenate(out_b).astype(np.int32))],
        names=["doc_id", "_text", "start", "stop"])


def _walk(window: int, chunk_bytes: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < chunk_bytes:
                continue
            rows = pa.Table.from_batches(held)
            rank = rows.column("rank").to_numpy()
            whole = int(np.searchsorted(rank, rank[-1]))  # the last group may go on
            if whole:
                yield _spans_of(rows.slice(0, whole), window)
            held = rows.slice(whole).to_batches()
            size = sum(b.nbytes for b in held) if whole else 0
        if held:
            yield _spans_of(pa.Table.from_batches(held), window)

    return walk


def _hot_spans(hot: DataFrame, window: int) -> DataFrame:
    """The same for ranks of very many rows: every passage a row, reduced per 128-bit rank before copies meet it."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("run")):
                count = np.diff(offsets) - window + 1
                owner = np.repeat(np.arange(hi - lo), count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                index = offsets[:-1][owner] + at
                n1, n2 = ranks(data, window)[index], ranks(data, window, _SECOND)[index]
                rows = pa.array(owner + lo)
                start = batch.column("place").take(rows).to_numpy() // window + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(n1)), pa.array(signed(n2)), batch.column("doc_id").take(rows), batch.column("_text").take(rows), pa.array(start.astype(np.int32))],
                    names=["n1", "n2", "doc_id", "_text", "start"])

    rows = hot.mapInArrow(explode, "n1 long, n2 long, doc_id long, _text long, start int")
    firsts = materialize(rows.groupBy("n1", "n2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last"), "hot-passages")
    return rows.join(firsts, ["n1", "n2"]).where(F.col("doc_id") > F.col("_first")).select(
        "doc_id", "_text", "start", (F.col("start") + window).cast("int").alias("stop"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot_rows: int = HOT_ROWS, long_bytes: int = LONG_BYTES,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text hash, start and stop of bytes a smaller doc_id has too; spans may overlap."""
    cold, hot = passages(docs, window, hot_rows, long_bytes)
    prefix = F.expr(f"substring(run, cast(place % {window} as int) + 1, {PREFIX})")
    ranked_runs = cold.repartition(prefix).withColumn("rank", F.xxhash64(prefix)).sortWithinPartitions("rank", "run", "doc_id")
    return ranked_runs.mapInArrow(_walk(window, chunk_bytes), SPAN).unionByName(_hot_spans(hot, window))


def dedup_bytes(docs: DataFrame, window: int = WINDOW, hot_rows: int = HOT_ROWS, long_bytes: int = LONG_BYTES,
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (bytes left) for every row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    spans = repeated_spans(rows.where(f"doc_id is not null and octet_length(text) >= {window}"), window, hot_rows, long_bytes, chunk_bytes)
    cut = materialize(spans.groupBy("doc_id", "_text").agg(F.collect_list("start").alias("a"), F.collect_list("stop").alias("b")), "repeated-spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opens, closes = batch.column("a"), batch.column("b")
            for lo, hi, data, offsets in blocks(batch.column("text")):
                removed, spans, kept = [], [], []
                for r in range(hi - lo):
                    text = data[offsets[r]:offsets[r + 1]]
                    if not opens[lo + r].is_valid:
                        removed.append(0)
                        spans.append(0)
                        kept.append(text.tobytes())
                        continue
                    a, b = (np.array(x[lo + r].as_py()) for x in (opens, closes))
                    deep = np.zeros(len(text) + 1, np.int64)
                    np.add.at(deep, a, 1)
                    np.add.at(deep, b, -1)
                    gone = np.cumsum(deep)[:-1] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(text[~gone].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(cut, ["doc_id", "_text"], "left").select("doc_id", "text", "a", "b").mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same rows from the definition, for tests."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    low: dict[bytes, int] = {}
    for d, t in raw:
        for i in range(len(t) - window + 1) if d is not None else ():
            key = t[i:i + window]
            low[key] = min(low.get(key, d), d)
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1) if d is not None else ():
            if low[t[i:i + window]] < d:
                gone[i:i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
