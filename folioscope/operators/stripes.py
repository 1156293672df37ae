"""Chunk starts of pages too long for one task.

What a chunk holds when it opens depends on one place alone: the operation that opens it, by itself or with the item before
it. So a stripe of operations has two nodes an operation, and each node leads to the node that opens the next chunk
(``Chains``); following them from every node gives all states a stripe can end in, without knowing how it is entered. Those are
the only states the next stripe can be entered with, so every stripe becomes a small table from entries to ends.
Tables are composed by doubling: after r rounds it is known how the first 2^r stripes are entered.

A stripe without a chunk start (its blocks fit, all together, into the chunk that is open) hands on states that are not its
own; each stripe in a row of such stripes adds a round. Rounds therefore grow with the logarithm of the stripes of a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from folioscope.operators.joins import join_chosen
from folioscope.session import cut_lineage, has_rows

PLACE = ["page_id", "stripe"]
STATE = ["tokens", "items"]
#: How many items a state counts; the rules ask for no more.
MOST_ITEMS = 3


class Chains:
    """Nodes of one stripe: 2i opens a chunk with operation i (or, at a break, leaves none open), 2i + 1 with items i - 1 and i."""

    def __init__(self, ops: np.ndarray, sizes: np.ndarray, before: int, max_tokens: int) -> None:
        self.ops, self.sizes, self.max_tokens = ops, sizes, max_tokens
        self.n = n = len(ops)
        self.sums = np.concatenate([[0], np.cumsum(sizes)])
        breaks = np.where(ops == "B", np.arange(n), n)
        self.next_break = np.append(np.minimum.accumulate(breaks[::-1])[::-1], n)
        at = np.repeat(np.arange(n), 2)
        single = np.arange(2 * n) % 2 == 0
        earlier = np.append(before, sizes[:-1])
        tokens = np.where(single, sizes[at], sizes[at] + earlier[at])
        items = np.where(single, np.where(ops[at] == "B", 0, 1), 2)
        self.following, self.tokens, self.items = self._advance(at, tokens, items)
        # Nodes point forward only, so following pointers of pointers ends at the last node of each chain.
        self.last = np.where(self.following < 0, np.arange(2 * n), self.following)
        while (self.last[self.last] != self.last).any():
            self.last = self.last[self.last]

    def _advance(self, at: np.ndarray, tokens: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From states just after operation ``at``: the node that opens the next chunk, or -1 and the state at the stripe's end."""
        n, sums, top = self.n, self.sums, self.max_tokens
        at, tokens, items = (np.array(x, np.int64) for x in (at, tokens, items))
        node = np.full(len(at), -1)
        live = np.arange(len(at))
        while len(live):
            p, t, c = at[live], tokens[live], items[live]
            over = np.maximum(np.searchsorted(sums, top - t + sums[p + 1], side="right") - 1, p + 1)
            stop = np.where(c == 0, p + 1, np.minimum(over, self.next_break[np.minimum(p + 1, n)]))
            t, c = t + sums[np.minimum(stop, n)] - sums[p + 1], c + np.minimum(stop, n) - p - 1
            ended = stop >= n
            tokens[live[ended]], items[live[ended]] = t[ended], np.minimum(c[ended], MOST_ITEMS)
            live, stop, t, c = live[~ended], stop[~ended], t[~ended], c[~ended]
            op, size = self.ops[stop], self.sizes[stop]
            alone = (op != "F") | (c == 0) | (size > t) | (t == 0)
            opens = alone | (c > 2)
            node[live[opens]] = (2 * stop + ~alone)[opens]
            live, stop = live[~opens], stop[~opens]
            at[live], tokens[live], items[live] = stop, (t + size)[~opens], c[~opens] + 1
        return node, tokens, items

    def ends(self) -> np.ndarray:
        """All states (tokens, items) that a chunk opened in this stripe can leave it in."""
        last = np.unique(self.last)
        return np.unique(np.column_stack([self.tokens[last], self.items[last]]), axis=0)

    def exits(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First node and end state of every entry."""
        node, tokens, items = self._advance(np.full(len(entries), -1), entries[:, 0], entries[:, 1])
        last = self.last[np.maximum(node, 0)]
        ends = np.column_stack([np.where(node < 0, tokens, self.tokens[last]), np.where(node < 0, items, self.items[last])])
        return node, ends

    def starts(self, entry: np.ndarray) -> np.ndarray:
        """Places of the operations that open a chunk, -1 for the item before the stripe."""
        node, found = int(self.exits(entry[None])[0][0]), []
        while node >= 0:
            if self.ops[node >> 1] != "B":
                found.append((node >> 1) - (node & 1))
            node = int(self.following[node])
        return np.array(found, np.int64)


def _chains(batch: pa.RecordBatch, row: int, max_tokens: int) -> Chains:
    ops = np.array(batch.column("op")[row].as_py(), object)
    return Chains(ops, batch.column("size")[row].values.to_numpy(), batch.column("before")[row].as_py() or 0, max_tokens)


def _rows(batch: pa.RecordBatch, counts: list[int], names: list[str], **values: np.ndarray) -> pa.RecordBatch:
    """``names`` of the batch repeated ``counts`` times each, and values of their own."""
    at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *(pa.array(v, pa.int64()) for v in values.values())], names=[*names, *values])


def _schema(stripes: DataFrame, names: list[str], *values: str) -> T.StructType:
    return T.StructType([*(stripes.schema[c] for c in names), *(T.StructField(v, T.LongType()) for v in values)])


def end_states(stripes: DataFrame, max_tokens: int) -> DataFrame:
    """page_id, next, tokens, items: what every stripe can hand to the next."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_chains(batch, r, max_tokens).ends() for r in range(batch.num_rows)]
            if found:
                flat = np.concatenate(found)
                yield _rows(batch, [len(f) for f in found], ["page_id", "next"], tokens=flat[:, 0], items=flat[:, 1])

    names = ["page_id", "next"]
    return stripes.where("next is not null").mapInArrow(scan, _schema(stripes, names, *STATE))


def transitions(stripes: DataFrame, entries: DataFrame, max_tokens: int) -> DataFrame:
    """page_id, stripe, tokens, items, next, to_tokens, to_items: the end of each stripe for each of ``entries``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            came, left = [], []
            for r in range(batch.num_rows):
                states = batch.column("entries")[r].values
                came.append(np.column_stack([states.field(c).to_numpy() for c in STATE]))
                left.append(_chains(batch, r, max_tokens).exits(came[-1])[1])
            if came:
                a, b = np.concatenate(came), np.concatenate(left)
                yield _rows(batch, [len(c) for c in came], [*PLACE, "next"], tokens=a[:, 0], items=a[:, 1], to_tokens=b[:, 0], to_items=b[:, 1])

    grouped = entries.groupBy(*PLACE).agg(F.collect_set(F.struct(*STATE)).alias("entries"))
    both = join_chosen(stripes, grouped, PLACE, salt_by=PLACE)
    return both.mapInArrow(scan, _schema(stripes, [*PLACE, "next"], *STATE, "to_tokens", "to_items"))


def _compose(known: DataFrame, jumps: DataFrame) -> DataFrame:
    """Jumps of twice the length."""
    further = jumps.select("page_id", F.col("stripe").alias("next"), F.col("tokens").alias("to_tokens"), F.col("items").alias("to_items"),
                           F.col("next").alias("_n"), F.col("to_tokens").alias("_t"), F.col("to_items").alias("_i"))
    both = known.join(further, ["page_id", "next", "to_tokens", "to_items"])
    return both.select(*PLACE, *STATE, F.col("_n").alias("next"), F.col("_t").alias("to_tokens"), F.col("_i").alias("to_items")).where("next is not null")


def entry_states(stripes: DataFrame, max_tokens: int) -> DataFrame:
    """page_id, stripe, tokens, items: how every stripe is entered."""
    handed = end_states(stripes, max_tokens).select("page_id", F.col("next").alias("stripe"), *STATE)
    fresh = stripes.where("first").select(*PLACE, *(F.lit(0).cast("bigint").alias(c) for c in STATE))
    entries = cut_lineage(fresh.unionByName(handed).distinct())
    jumps = new = cut_lineage(transitions(stripes, entries, max_tokens))
    while True:  # states that pass through whole stripes
        passed = new.where("next is not null").select("page_id", F.col("next").alias("stripe"), F.col("to_tokens").alias("tokens"), F.col("to_items").alias("items"))
        passed = cut_lineage(passed.distinct().join(entries, [*PLACE, *STATE], "left_anti"))
        if not has_rows(passed):
            break
        entries = entries.unionByName(passed)
        new = cut_lineage(transitions(stripes, passed, max_tokens))
        jumps = jumps.unionByName(new)
    jumps = cut_lineage(jumps.where("next is not null"))
    known = cut_lineage(fresh)
    while True:
        reached = known.join(jumps, [*PLACE, *STATE]).select(
            "page_id", F.col("next").alias("stripe"), F.col("to_tokens").alias("tokens"), F.col("to_items").alias("items"))
        reached = cut_lineage(reached)
        if not has_rows(reached):
            return known
        known = known.unionByName(reached)
        jumps = cut_lineage(_compose(jumps, jumps))


def chunk_starts(operations: DataFrame, max_tokens: int) -> DataFrame:
    """page_id, ord: the operations that open a chunk, from rows ``page_id, stripe, ord, op, size``."""
    lists = operations.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("ord", "op", "size"))).alias("o"))
    inside = operations.groupBy(*PLACE).agg(F.max(F.struct("ord", "op", "size")).alias("_last"))
    order = Window.partitionBy("page_id").orderBy("stripe")  # a row a stripe
    around = inside.select(*PLACE, F.lead("stripe").over(order).alias("next"), (F.row_number().over(order) == 1).alias("first"),
                           F.lag("_last").over(order).alias("_before"))
    stripes = cut_lineage(lists.join(around, PLACE).select(
        *PLACE, "next", "first", F.col("_before.size").alias("before"), F.col("_before.ord").alias("before_ord"),
        F.col("o.ord").alias("ord"), F.col("o.op").alias("op"), F.col("o.size").alias("size")))
    entered = entry_states(stripes, max_tokens)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                entry = np.array([batch.column(c)[r].as_py() for c in STATE])
                orders = np.append(batch.column("ord")[r].values.to_numpy(), batch.column("before_ord")[r].as_py() or 0)
                found.append(orders[_chains(batch, r, max_tokens).starts(entry)])
            if found:
                yield _rows(batch, [len(f) for f in found], ["page_id"], ord=np.concatenate(found))

    return join_chosen(stripes, entered, PLACE, salt_by=PLACE).mapInArrow(scan, _schema(stripes, ["page_id"], "ord"))
