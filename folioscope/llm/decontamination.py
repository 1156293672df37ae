"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words become one automaton that accepts every run of words of every item. Training words are streamed through
it and the longest match that ends at each word is tracked; where it reaches the window length (or a whole item that is
shorter), those words are hit. Spans of hit words are cut out, and documents hit beyond a share of their words go.

Words outside the items' vocabulary, and word pairs no item has, break every match; they are found for a whole block of
text at once, and only the stretches between them that are long enough to hold a window enter the automaton.

Items are cut into overlapping pieces in Spark and taken in blocks of at most ``BLOCK_WORDS`` words, one block after
another, so what the driver holds and sends to the tasks is bounded however long the benchmark or one of its items is;
training texts are never shuffled while they are searched. Several blocks meet in narrow rows per document.

Null or empty texts have no words and are never hit; items without words are never found. Repeated rows are judged one by
one, equal items are all named. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm.store import materialize, table
from folioscope.llm.words import LOWER, NOT_ALNUM, Words, blocks, signed
from folioscope.session import run_dir

WINDOW = 10
BLOCK_WORDS = 50_000
MAX_COVERAGE_PERCENT = 50
HITS = "n_words long, n_hit long, spans array<struct<start:int,end:int,first:int,last:int>>, items array<string>"

Items = list[tuple[str, list[int]]]


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, NOT_ALNUM, LOWER)


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Names of the words of each text."""
    found = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        w = _words(data, offsets)
        found += np.split(w.names, np.cumsum(w.counts())[:-1])
    return found


def item_pieces(benchmark: DataFrame, size: int, window: int) -> DataFrame:
    """part, before, n, item, words: the items' word names in pieces of at most ``size`` words.

    Pieces of one item overlap by ``window`` - 1 words and none is shorter than a window, so every window lies in a piece
    and no piece is taken for a short item. ``before`` counts the words ahead of a piece in its part.
    """
    step = size - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                words = item_words([text.as_py()])[0]
                for lo in range(0, max(1, len(words) - window + 1) if len(words) else 0, step):
                    piece = words[lo:lo + size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(piece)], pa.int64()), pa.array([item.as_py()], pa.string()),
                         pa.array([signed(piece)], pa.list_(pa.int64()))], names=["part", "before", "n", "item", "words"])
                    before += len(piece)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut, "part int, before long, n long, item string, words array<long>")


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[Items]:
    """The items with their word names, a block at a time; the driver holds one block and a count for each part of the table.

    What fits is one block. Otherwise the running count of words is cut at every half block; pieces are no longer than
    that, so a block holds at most ``block_words`` (or two windows).
    """
    half = max(block_words // 2, window)
    stored = materialize(item_pieces(benchmark, half, window), "item-pieces")
    parts = stored.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total = sum(r.n for r in parts)
    share = max(block_words, window) if total <= block_words else half
    ends = np.cumsum([0, *(r.n for r in parts)]).tolist()
    starts = {r.part: start for r, start in zip(parts, ends)}
    for number in range(-(-total // share)):
        lo, hi = number * share, (number + 1) * share
        held = [r.part for r, a, b in zip(parts, ends, ends[1:]) if a < hi and b > lo]
        if not held:
            continue
        # Parts in full or from both ends: a condition for each part that the block meets.
        own = reduce(or_, ((F.col("part") == p) & (F.col("before") >= lo - starts[p]) & (F.col("before") < hi - starts[p]) for p in held))
        block = stored.where(own).select("item", "words").toArrow()
        items = [(i, np.array(w, np.int64).view(np.uint64).tolist()) for i, w in zip(block["item"].to_pylist(), block["words"].to_pylist())]
        if items:
            yield items


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the start."""

    def __init__(self, items: Items, window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary = np.unique(np.array([w for _, words in items for w in words], np.uint64))
        code = {w: k for k, w in enumerate(self.vocabulary.tolist())}
        runs = [[code[w] for w in words] for _, words in items]
        self.ids = [item for item, _ in items]
        self.steps: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        for run in runs:
            last = 0
            for c in run:
                last = self._extend(last, c)
        pairs = [np.array(r, np.int64)[:-1] * len(self.vocabulary) + np.array(r, np.int64)[1:] for r in runs]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.least = min((min(len(r), window) for r in runs), default=window)
        self._name(runs)

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.steps.append(steps)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the strings of ``q`` that are at most one longer than those of ``p``."""
        twin = self._state(self.length[p] + 1, dict(self.steps[q]), self.link[q])
        while p >= 0 and self.steps[p].get(c) == q:
            self.steps[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.steps[last].get(c)
        if q is not None:  # another item has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.steps[p]:
            self.steps[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.steps[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _name(self, runs: list[list[int]]) -> None:
        """For each state the items that hold its strings, and the short items that end there."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.held: list[set[int]] = [set() for _ in self.length]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for k, run in enumerate(runs):
            state = 0
            for c in run:
                state = self.steps[state][c]
                up = state
                while up > 0 and self.length[up] >= self.window and k not in self.held[up]:
                    self.held[up].add(k)
                    up = self.link[up]
            if len(run) < self.window:
                self.short[state].append((len(run), k))
        #: The state of the last ``window`` words of a match.
        self.top = list(range(len(self.length)))
        for s in order:
            up = self.link[s]
            if up > 0:
                self.short[s] = self.short[s] + self.short[up]
                if self.length[up] >= self.window:
                    self.top[s] = self.top[up]

    def stretches(self, w: Words) -> Iterator[tuple[int, np.ndarray]]:
        """First word and codes of every run of words that could hold a window."""
        if not len(w.names) or not len(self.vocabulary):
            return
        code = np.searchsorted(self.vocabulary, w.names)
        np.minimum(code, len(self.vocabulary) - 1, out=code)
        known = self.vocabulary[code] == w.names
        joined = known[:-1] & known[1:] & (w.row[:-1] == w.row[1:])
        at = np.flatnonzero(joined)
        joined[at] = np.isin(code[at] * len(self.vocabulary) + code[at + 1], self.pairs)
        cuts = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(code)]])
        for lo, hi in zip(cuts[:-1][np.diff(cuts) >= self.least].tolist(), cuts[1:][np.diff(cuts) >= self.least].tolist()):
            if known[lo]:
                yield lo, code[lo:hi]

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """(place after the match, its length, items) wherever a window or a whole short item ends."""
        state = length = 0
        for i, c in enumerate(codes.tolist()):
            while state and c not in self.steps[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.steps[state]:
                state, length = self.steps[state][c], length + 1
            else:
                continue
            if length >= self.window:
                yield i + 1, length, self.held[self.top[state]]
            for m, k in self.short[state]:
                if m <= length:
                    yield i + 1, m, {k}


def _hits(w: Words, automaton: Automaton) -> dict[int, tuple[np.ndarray, set[str]]]:
    """Hit words and found items of the rows that have any."""
    found: dict[int, tuple[np.ndarray, set[str]]] = {}
    first, counts = w.first(), w.counts()
    for lo, codes in automaton.stretches(w):
        row = int(w.row[lo])
        for end, length, items in automaton.matches(codes):
            if row not in found:
                found[row] = np.zeros(counts[row], bool), set()
            place = lo - first[row] + end
            found[row][0][place - length:place] = True
            found[row][1].update(automaton.ids[k] for k in items)
    return found


def _spans(w: Words, row: int, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words, as bytes and as word numbers."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    base = int(w.first()[row])
    return [{"start": int(w.start[base + a]), "end": int(w.end[base + b - 1]), "first": a, "last": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def search(docs: DataFrame, sent: Broadcast[Items], window: int, only_hit: bool) -> DataFrame:
    """``docs`` (with a ``text`` column) without the text, with word counts, spans and items of one block of items."""
    rest = [c for c in docs.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value, window)
        span = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "first", "last")]))
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                w = _words(data, offsets)
                found = _hits(w, automaton)
                rows = sorted(found) if only_hit else range(hi - lo)
                none = np.zeros(0, bool), set()
                spans = []
                for r in rows:
                    own = _spans(w, r, found[r][0]) if r in found else []
                    for s in own:
                        s["start"] -= int(offsets[r])
                        s["end"] -= int(offsets[r])
                    spans.append(own)
                taken = pa.array([lo + r for r in rows], pa.int64())
                counts = w.counts()
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(taken) for c in rest), pa.array([int(counts[r]) for r in rows], pa.int64()),
                    pa.array([int(found.get(r, none)[0].sum()) for r in rows], pa.int64()), pa.array(spans, span),
                    pa.array([sorted(found.get(r, none)[1]) for r in rows], pa.list_(pa.string()))],
                    names=[*rest, "n_words", "n_hit", "spans", "items"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(scan, f"{kept}, {HITS}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, ``_text`` (its text's hash), n_words, n_hit, spans, items.

    With more than one block of items the spans of a document are united; equal rows are counted and given back as often.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    spark = docs.sparkSession
    found = item_blocks(benchmark, block_words, window)
    first, second = next(found, []), next(found, None)
    if second is None:
        return search(rows, spark.sparkContext.broadcast(first), window, only_hit=False)
    path = run_dir(spark, "block-hits")
    for number, items in enumerate(chain([first, second], found)):
        sent = spark.sparkContext.broadcast(items)
        hits = search(rows, sent, window, only_hit=number > 0).withColumn("_copies", F.lit(int(number == 0)).cast("long"))
        hits.write.mode("append").parquet(path)
        sent.destroy()
    parts = spark.read.schema(hits.schema).parquet(path)
    one = parts.groupBy("doc_id", "_text").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("_copies").alias("_copies"))
    united = one.mapInArrow(_united, f"doc_id long, _text long, {HITS}, _copies long")
    return united.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies", "col")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, hits = [], []
        for own in batch.column("spans").to_pylist():
            joined: list[dict[str, int]] = []
            for s in sorted(own, key=lambda x: (x["first"], x["last"])):
                if joined and s["first"] <= joined[-1]["last"]:
                    if s["last"] > joined[-1]["last"]:
                        joined[-1]["last"], joined[-1]["end"] = s["last"], s["end"]
                else:
                    joined.append(dict(s))
            spans.append(joined)
            hits.append(sum(s["last"] - s["first"] for s in joined))
        c = {n: batch.column(n) for n in batch.schema.names}
        yield pa.RecordBatch.from_arrays(
            [c["doc_id"], c["_text"], c["n_words"], pa.array(hits, pa.int64()), pa.array(spans, c["spans"].type), c["items"], c["_copies"]],
            names=["doc_id", "_text", "n_words", "n_hit", "spans", "items", "_copies"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: int = MAX_COVERAGE_PERCENT,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans; documents with more than ``max_coverage`` percent of their words hit go.

    Only documents with hits take part in the join, as (doc_id, text hash, spans).
    """
    hit = (
        contamination(docs, benchmark, window, block_words).where("n_hit > 0").dropDuplicates(["doc_id", "_text"])
        .select(F.col("doc_id").alias("_id"), "_text", "spans", (F.col("n_hit") * 100 > F.col("n_words") * max_coverage).alias("_too_much")))
    hit = materialize(hit, "benchmark-hits")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.xxhash64("text").alias("_text"), F.col("doc_id").alias("_id"))
    joined = d.join(hit, (d["_id"].eqNullSafe(hit["_id"])) & (d["_text"] == hit["_text"]), "left").where("_too_much is null or not _too_much")
    whole = F.encode(F.col("_row.text"), "UTF-8")
    n = F.size("spans")
    # What lies between the spans: from the end of one to the start of the next.
    between = F.transform(F.sequence(F.lit(0), n), lambda i: F.decode(F.substring(
        whole, F.coalesce(F.get("spans", i - 1).end, F.lit(0)) + 1,
        F.coalesce(F.get("spans", i).start, F.octet_length("_row.text")) - F.coalesce(F.get("spans", i - 1).end, F.lit(0))), "UTF-8"))
    text = F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(F.array_join(between, ""))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*((new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same rows from the definition, for tests."""
    import re

    def words(text: str | None) -> list[bytes]:
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())

    windows: dict[tuple, set[str]] = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, items = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i:i + n]))) is not None:
                    hit[i:i + n] = [True] * n
                    items |= own
        names = ",".join(sorted(items))
        out.append((doc, len(w), sum(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), any(hit)))
    return out
