"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

A document is its ids and one end mark. Whole windows are cut off its front; what remains goes, document after document,
to the fill level that makes the sum of squared counts of partly filled windows smallest: an array holds how many open
windows there are of each level, and a place costs what it changes in that sum. Windows that are still open at the end
are put together where they fit (largest first into the fullest), and what then remains is padding.

Tokenizing is one pass and writes only narrow rows (or ids too, with ``keep_ids``). Those are dealt into groups of about
``GROUP_PIECES`` pieces by hash, as many groups as the table needs, and each group is packed as a stream in doc_id order:
memory holds the open windows of one group. The place of a row in the stored table is hashed too, so equal rows are spread over all
groups. Cuts and checksums depend on the document alone and ids of sequences on (group, order), so a repeated task gives the same rows.

Null or empty text is a document of its end mark alone. Repeated rows are packed as often as they occur; null doc_ids
are packed like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm.bpe import Encoder
from folioscope.llm.store import materialize, table

WINDOW = 2_048
END_MARK = 1
GROUP_PIECES = 16_384
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_GROUP_SHIFT = 32


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Documents cut into runs of at most ``window`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            kept = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(END_MARK)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start:start + window]
                    for name, value in zip(rows, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids))):
                        rows[name].append(value)
                    if keep_ids:
                        kept.append(part.astype(np.int64))
                if len(rows["start"]) >= 8_192:
                    yield out(rows, kept)
                    rows, kept = {name: [] for name in rows}, []
            yield out(rows, kept)

    def out(rows: dict[str, list], kept: list) -> pa.RecordBatch:
        arrays = {name: pa.array(values, pa.int64()) for name, values in rows.items()}
        if keep_ids:
            arrays["ids"] = pa.array(kept, pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(arrays)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + ", ids array<long>" * keep_ids)


class Packer:
    """Open windows by fill level; ``place`` gives the window a piece goes to."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.members: dict[int, list[int]] = {}
        self.next = 0

    def place(self, piece: int, size: int) -> list[int] | None:
        """Put a piece in; the pieces of the window it fills, if it fills one."""
        if size == self.window:
            return [piece]
        n, top = self.level, self.window - size
        gain = 2 * (n[size:] - n[:top + 1]) + 2  # a window leaves level h for h + size
        gain[0] = 2 * n[size] + 1  # a new window leaves none
        gain[top] = 1 - 2 * n[top]  # a full one arrives nowhere
        gain[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(gain[::-1]))
        if h:
            window = self.open[h].pop()
            n[h] -= 1
        else:
            window, self.next = self.next, self.next + 1
            self.members[window] = []
        self.members[window].append(piece)
        if h == top:
            return self.members.pop(window)
        self.open[h + size].append(window)
        n[h + size] += 1
        return None

    def close(self) -> Iterator[list[int]]:
        """What is still open, put together where it fits."""
        room: dict[int, list[list[int]]] = {}
        for h in range(self.window, 0, -1):
            for window in self.open[h]:
                fit = min((r for r in room if r >= h), default=None)
                if fit is None:
                    into, left = [], self.window - h
                else:
                    into, left = room[fit].pop(), fit - h
                    if not room[fit]:
                        del room[fit]
                into += self.members[window]
                room.setdefault(left, []).append(into)
        for left in sorted(room):
            yield from room[left]


def packed(cut: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset``."""
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = (
        cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
        .repartition(groups, "_group")
        .sortWithinPartitions("_group", "doc_id", "start", "ids_crc32")
    )
    names = cut.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, sequence = None, Packer(window), 0
        waiting: dict[int, tuple] = {}
        number = 0
        rows: list[tuple] = []

        def emit(members: list[int]) -> None:
            nonlocal sequence
            offset = 0
            for m in members:
                row = waiting.pop(m)
                rows.append((*row, (group << _GROUP_SHIFT) | sequence, offset))
                offset += row[names.index("length")]
            sequence += 1

        def finish() -> None:
            for members in packer.close():
                emit(members)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                long = pa.int64()
                schema = pa.schema([*(batch.schema.field(n) for n in names), pa.field("sequence_id", long), pa.field("offset", long)])
            columns = [batch.column(n).to_pylist() for n in names]
            sizes = batch.column("length").to_pylist()
            for g, size, *row in zip(batch.column("_group").to_pylist(), sizes, *columns):
                if g != group:
                    finish()
                    group, packer, sequence = g, Packer(window), 0
                waiting[number] = tuple(row)
                full = packer.place(number, size)
                number += 1
                if full:
                    emit(full)
            if len(rows) >= 8_192:
                yield out()
        if schema is not None:
            finish()
            yield out()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.mapInArrow(pack, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: where it comes from in its document and where it lies in its sequence."""
    return packed(materialize(pieces(docs, path, window, keep_ids), "pieces"), window, group_pieces)


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
