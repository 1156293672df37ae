"""Exact nearest rows by squared L2 distance, ties on id.

The question vectors are sent to the tasks in blocks bounded in bytes and in answers, and the index is read in place, once
per pass: as many blocks share a pass as a task may hold the answers of. Several passes are one job, and the more there are the
fewer tasks share the index for one. A task looks at a bounded number of index rows and pairs at a time and shuffles only its own
k best rows per question. Answers do not depend on the size of the blocks or on batches.

One rule for odd vectors, everywhere: a null vector, and one with a null, NaN or infinite element, is no vector, and its row
is left out; vectors of unequal length are an error.

Distances are added up dimension by dimension in double precision, so they do not depend on batching. A matrix
product with a rounding allowance, in single precision where the numbers allow it, only chooses which pairs are worth that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.session import cut_lineage, run_dir

BLOCK_BYTES = 64 << 20
#: Answers (questions times k) of a pass, and so of a block: every task holds as many for its part of the index.
BLOCK_ANSWERS = 400_000
#: Passes of one job, as long as ``BLOCK_BYTES`` hold the blocks of all.
BLOCKS_AT_ONCE = 16
ROWS_AT_ONCE = 4_096
PAIR_TILE = 1_000_000
#: Pairs whose distances are added up at once.
PAIRS_AT_ONCE = 100_000
SPLITS_PER_TASK = 16
#: Squared norms and dimensions up to which single precision chooses the pairs.
SINGLE_NORM, SINGLE_DIM = 1e30, 10_000


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Vectors without nulls as rows; an error where one has another length than ``dim`` (or than the others)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, dim or 0))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    dim = int(lengths[0]) if dim is None else dim
    if (lengths != dim).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()) | {dim})[:5]} elements cannot be compared")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


def _usable(vectors: pa.Array) -> np.ndarray:
    """Which entries are vectors: not null, and every element a finite number."""
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    odd = ~np.isfinite(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    valid[np.repeat(np.arange(len(vectors)), lengths)[odd]] = False
    return valid


def _with_vectors(rows, vec_col: str):
    """Rows of an Arrow batch or table that have a usable vector."""
    column = rows.column(vec_col)
    return rows.filter(pa.array(_usable(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)))


def is_vector(vectors: Column) -> Column:
    """The same as a column: true for arrays of finite numbers."""
    return F.coalesce(F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _pair_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared L2 between equally long lists of vectors given column-major, summed in dimension order."""
    total = np.zeros(x.shape[1])
    for a, b in zip(x, q):
        step = a - b
        total += step * step
    return total


def squared_l2(a: Column, b: Column) -> Column:
    """Squared L2 distance of two vector columns; null unless both are vectors, an error if their lengths differ."""

    @F.arrow_udf(T.DoubleType())
    def distance(x: pa.Array, q: pa.Array) -> pa.Array:
        parts = [part(x.slice(lo, ROWS_AT_ONCE), q.slice(lo, ROWS_AT_ONCE)) for lo in range(0, len(x), ROWS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    def part(x: pa.Array, q: pa.Array) -> pa.Array:
        mask = _usable(x) & _usable(q)
        out = np.full(len(x), np.nan)
        if mask.any():
            known = pa.array(mask)
            left = _matrix(x.filter(known))
            out[mask] = _pair_distances(left.T, _matrix(q.filter(known), left.shape[1]).T)
        return pa.array(out, mask=~mask)

    return distance(a, b)


def _places(groups: np.ndarray) -> np.ndarray:
    """Place of every element within its run of equal neighbours, from 0."""
    start = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))


def _without_spare_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` to look at. Equal vectors are equally far from anything, so of each only the first k rows can matter."""
    mark = x @ np.cos(np.arange(x.shape[1]))
    order = np.argsort(mark, kind="stable")
    place = _places(mark[order])
    if place.max(initial=0) < k:
        return np.arange(len(x))
    leader = order[np.arange(len(order)) - place]
    copy = np.ones(len(x), bool)
    shared = place > 0
    copy[shared] = (x[order[shared]] == x[leader[shared]]).all(axis=1)
    seen = np.cumsum(copy)
    before = seen - copy - (seen - copy)[np.arange(len(order)) - place]
    return np.sort(order[~copy | (before < k)])


@dataclass
class _Questions:
    """A bounded set of question vectors with their norms; with ``buckets``, a row of numbers a question, a question looks
    only at index rows that share the number of at least one place with it."""

    vectors: np.ndarray
    buckets: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.norms = (self.vectors**2).sum(axis=1)
        self._single = (-2 * self.vectors).astype(np.float32) if self._fits_single(self.norms) else None

    def _fits_single(self, norms: np.ndarray) -> bool:
        return norms.max(initial=0.0) < SINGLE_NORM and self.vectors.shape[1] < SINGLE_DIM

    def _distances(self, columns: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
        """Exact distances of pairs, a bounded number at a time; ``columns`` are the rows, column-major."""
        distance = np.zeros(len(qi))
        for lo in range(0, len(qi), PAIRS_AT_ONCE):
            part, q, r = distance[lo:lo + PAIRS_AT_ONCE], qi[lo:lo + PAIRS_AT_ONCE], ri[lo:lo + PAIRS_AT_ONCE]
            for a, b in zip(columns, self.columns):
                gap = a[r] - b[q]
                gap *= gap
                part += gap
        return distance

    def candidates(self, x: np.ndarray, k: int, bound: np.ndarray, buckets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (question, row, distance) among which the k best rows of every question are found, earlier rows first.

        ``bound`` is a distance the k-th best of a question is already known not to exceed, ``buckets`` those of the rows.
        """
        n, dim = x.shape
        norms = (x**2).sum(axis=1)
        columns = np.ascontiguousarray(x.T)
        single = self._single is not None and self._fits_single(norms)
        kind = np.float32 if single else np.float64
        # A product of ``dim`` terms is off by less than this share of both norms, and where these vanish by less than ``least``.
        share, least = 8 * (dim + 8) * float(np.finfo(kind).eps), (dim + 8) * float(np.finfo(kind).tiny)
        rows, low = np.ascontiguousarray(columns, kind), (norms * (1 - share)).astype(kind)
        found, waiting, held = [], [], 0

        def settle() -> None:
            nonlocal waiting, held
            qi, ri = (np.concatenate(part) for part in zip(*waiting))
            found.append((qi, ri, self._distances(columns, qi, ri)))
            waiting, held = [], 0

        step = max(1, PAIR_TILE // max(n, 1))
        space = np.empty((min(step, len(self.vectors)), n), kind)
        for lo in range(0, len(self.vectors), step):
            q = self._single[lo:lo + step] if single else -2 * self.vectors[lo:lo + step]
            # No pair is farther apart than what is ``near`` of it, plus the rest of the norm of the question.
            near = np.matmul(q, rows, out=space[:len(q)])
            near += low
            if self.buckets is not None:
                meet = np.zeros(near.shape, bool)
                for own, other in zip(self.buckets[lo:lo + step].T, buckets.T):
                    meet |= own[:, None] == other
                near[~meet] = np.inf
            limit = bound[lo:lo + step].copy()
            unbounded = np.flatnonzero(np.isinf(limit))
            if len(unbounded) and n > k:
                # The k rows that seem nearest bound the k-th best by their true distances.
                first = np.argpartition(near[unbounded], k - 1, axis=1)[:, :k]
                farthest = self._distances(columns, np.repeat(unbounded + lo, k), first.ravel()).reshape(-1, k).max(axis=1)
                few = ~np.isfinite(np.take_along_axis(near[unbounded], first, axis=1)).all(axis=1)
                limit[unbounded] = np.where(few, np.inf, farthest)
            limit = limit * (1 + share) - self.norms[lo:lo + step] * (1 - share) + least
            worth = near > limit.astype(kind)[:, None]
            np.logical_not(worth, out=worth)  # what overflowed, and cannot be compared, is worth a look
            if self.buckets is not None:
                worth &= meet
            qi, ri = np.divmod(np.flatnonzero(worth), n)
            qi += lo
            if len(qi) > 2 * k * len(q):  # many rows at one distance
                distance = self._distances(columns, qi, ri)
                order = np.lexsort((ri, distance, qi))
                order = order[_places(qi[order]) < k]
                found.append((qi[order], ri[order], distance[order]))
            elif len(qi):
                waiting.append((qi, ri))
                held += len(qi)
                if held >= PAIRS_AT_ONCE:
                    settle()
        if held:
            settle()
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found)) if found else (none, none, np.zeros(0))


def _keep_best(rows: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The k best rows per question; also each kept row's question and distance as arrays."""
    rows = rows.combine_chunks().sort_by([("_q", "ascending"), ("distance", "ascending"), ("_id", "ascending")])
    kept = rows.filter(pa.array(_places(rows["_q"].to_numpy()) < k))
    return kept, kept["_q"].to_numpy(), kept["distance"].to_numpy()


def _slices(batches) -> Iterator[pa.RecordBatch | pa.Table]:
    """The same rows, a bounded number at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(lo, ROWS_AT_ONCE)


def _bucket_rows(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _local_best(batches, questions: _Questions, k: int, vec_col: str, id_col: str, carry: Sequence[str],
                bucket_col: str | None = None) -> pa.Table | None:
    """Fold Arrow batches of index rows into the k best rows per question."""
    best, bound = None, np.full(len(questions.vectors), np.inf)
    waiting: list[pa.Table] = []
    for batch in _slices(batches):
        batch = _with_vectors(batch, vec_col)
        if batch.num_rows == 0:
            continue
        by_id = pc.sort_indices(batch.column(id_col)).to_numpy()
        x = _matrix(batch.column(vec_col), questions.vectors.shape[1])[by_id]
        kept = _without_spare_copies(x, k)
        buckets = _bucket_rows(batch.column(bucket_col))[by_id][kept] if bucket_col else None
        qi, ri, distance = questions.candidates(x[kept], k, bound, buckets)
        if len(qi) == 0:
            continue
        ri = by_id[kept[ri]]
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        rows = table.select([id_col, *carry]).rename_columns(["_id", *carry]).take(pa.array(ri))
        waiting.append(rows.append_column("_q", pa.array(qi, pa.int64())).append_column("distance", pa.array(distance)))
        # Rows that were found wait until they are half as many as the best ones; meanwhile the bounds are merely wider.
        if best is None or 2 * sum(rows.num_rows for rows in waiting) >= best.num_rows:
            best, q, d = _keep_best(pa.concat_tables(waiting if best is None else [best, *waiting]), k)
            waiting = []
            counts = np.bincount(q, minlength=len(bound))
            full = np.flatnonzero(counts >= k)
            ends = np.cumsum(counts) - 1
            bound[full] = d[ends[full]]
    return _keep_best(pa.concat_tables([best, *waiting]), k)[0] if waiting else best


def _answer(best: pa.Table, keys: pa.Table, schema: pa.Schema) -> pa.Table:
    """Put the question keys back in front of the kept rows."""
    q = best["_q"].combine_chunks() if best.num_rows else pa.array([], pa.int64())
    columns = {name: keys[name].take(q) for name in keys.column_names}
    for name in schema.names[len(columns):]:
        columns[name] = best["_id" if name not in best.column_names else name]
    return pa.table({name: columns[name].cast(schema.field(name).type) for name in schema.names}, schema=schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def _output_schema(index: DataFrame, queries: DataFrame, keys, id_col, carry) -> T.StructType:
    return T.StructType([queries.schema[c] for c in keys] + [index.schema[id_col], T.StructField("distance", T.DoubleType())]
                        + [index.schema[c] for c in carry])


def _rank(rows: DataFrame, keys: Sequence[str], id_col: str, k: int, carry: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("distance", id_col)
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*keys, "rank", id_col, "distance", *carry)


def _key_bytes(queries: DataFrame, name: str) -> Column:
    """About the bytes of a key column in a row."""
    if isinstance(queries.schema[name].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(8).cast("long")
    return F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)).cast("long") + 8


def knn(index: DataFrame, queries: DataFrame, k: int = 20, keys: Sequence[str] = ("qid", "qpos"), id_col: str = "id",
        vec_col: str = "embedding", query_col: str = "qvec", carry: Sequence[str] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` nearest index rows of every query: ``keys, rank, id, distance, carry``.

    Rows of either side without a usable vector are left out; vectors of unequal length are an error.
    """
    return nearest(index, queries, k, keys, id_col, vec_col, query_col, carry, block_bytes)


def nearest(index: DataFrame, queries: DataFrame, k: int, keys: Sequence[str], id_col: str, vec_col: str, query_col: str, carry: Sequence[str],
            block_bytes: int = BLOCK_BYTES, bucket_col: str | None = None) -> DataFrame:
    """``knn``; with ``bucket_col``, an array of numbers on both sides, only among rows that share one with the query at its place."""
    buckets = [bucket_col] if bucket_col else []
    index = index.select(id_col, vec_col, *buckets, *carry)
    # Stored before anything is asked of the vectors: a filter on them, the counts and the collection would each make them again.
    asked = cut_lineage(queries.select(*keys, query_col, *buckets)).filter(is_vector(F.col(query_col)))
    width = sum((_key_bytes(queries, c) for c in keys), F.lit(0).cast("long"))
    n, least, dim, named = asked.agg(F.count(F.lit(1)), F.min(F.size(query_col)), F.max(F.size(query_col)), F.sum(width)).first()
    if least != dim:
        raise ValueError(f"query vectors of {least} to {dim} elements cannot be compared")
    total = n * (dim or 0) * 8 + (named or 0)
    blocks = max(1, -(-total // block_bytes), -(-n * k // BLOCK_ANSWERS))

    if blocks == 1:
        one = [_scan(index, asked, asked.toArrow(), k, keys, id_col, vec_col, query_col, carry, bucket_col)]
        return _rank(_pass(one, 4 * index.sparkSession.sparkContext.defaultParallelism), keys, id_col, k, carry)
    # The questions pass over the index in blocks, as many at a time as a task may hold the answers of. The index is stored, so that
    # no pass makes or shuffles it again; what was found is appended to one table. A job has several passes, and the tasks it needs to
    # fill the cluster are shared among them. The blocks of a job are collected together and cut on the driver.
    index = cut_lineage(index)
    queries = cut_lineage(asked.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks))))
    path = run_dir(index.sparkSession, "nearest")
    together = max(1, min(BLOCK_BYTES * blocks // total, BLOCKS_AT_ONCE * max(1, BLOCK_ANSWERS * blocks // max(1, n * k))))
    for first in range(0, blocks, together):
        numbers = range(first, min(first + together, blocks))
        rows = queries.filter(F.col("_block").between(numbers[0], numbers[-1])).toArrow()
        scans = [_scan(index, asked, rows.filter(pc.equal(rows["_block"], number)).drop_columns("_block"), k, keys, id_col, vec_col, query_col, carry, bucket_col)
                 for number in numbers]
        shared = -(-len(scans) // BLOCKS_AT_ONCE)
        passes = [scans[lo:lo + shared] for lo in range(0, len(scans), shared)]
        tasks = -(-4 * index.sparkSession.sparkContext.defaultParallelism // len(passes))
        ranked = _rank(reduce(DataFrame.unionAll, [_pass(some, tasks) for some in passes]), keys, id_col, k, carry)
        ranked.write.mode("append").parquet(path)
        for scan in scans:
            scan.sent.destroy()
    return index.sparkSession.read.schema(ranked.schema).parquet(path)


@dataclass
class _Scan:
    """A block of questions, sent to the tasks, and what it asks of the index."""

    index: DataFrame
    schema: T.StructType
    sent: Broadcast
    k: int
    columns: tuple[str, str, Sequence[str], str | None]


def _scan(index, queries, asked: pa.Table, k, keys, id_col, vec_col, query_col, carry, bucket_col=None) -> _Scan:
    asked = _with_vectors(asked, query_col)
    sent = (asked.select(list(keys)).combine_chunks(), _matrix(asked[query_col]), _bucket_rows(asked[bucket_col]) if bucket_col else None)
    return _Scan(index, _output_schema(index, queries, keys, id_col, carry), index.sparkSession.sparkContext.broadcast(sent), k, (vec_col, id_col, carry, bucket_col))


def _pass(scans: Sequence[_Scan], tasks: int) -> DataFrame:
    """What a pass over the index finds for the questions of some blocks, up to k rows a question and task."""
    index, schema, k, columns = scans[0].index, scans[0].schema, scans[0].k, scans[0].columns
    arrow, sent = _arrow_schema(schema), [scan.sent for scan in scans]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [block.value for block in sent if block.value[0].num_rows]
        if asked:
            names, vectors, buckets = zip(*asked)
            vec_col, id_col, carry, bucket_col = columns
            questions = _Questions(np.concatenate(vectors), np.concatenate(buckets) if bucket_col else None)
            best = _local_best(batches, questions, k, vec_col, id_col, carry, bucket_col)
            if best is not None:
                yield from _answer(best, pa.concat_tables(names).combine_chunks(), arrow).to_batches()

    # Every task answers with up to k rows per question, so several small splits are read by one task.
    splits = index.rdd.getNumPartitions()
    return index.coalesce(max(tasks, -(-splits // SPLITS_PER_TASK))).mapInArrow(search, schema)
