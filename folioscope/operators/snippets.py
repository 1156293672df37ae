"""Chunks of the shortlisted documents: nearest per document, token budget, text per document.

Chunks are ranked and cut by ids, distances and token counts alone; texts are looked up for the chunks that are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from folioscope.operators.joins import join_chosen
from folioscope.operators.knn import squared_l2
from folioscope.session import cut_lineage
from folioscope.sources.chunks import located, part_column

# Each broadcast row carries a question vector.
MAX_VECTOR_ROWS = 20_000
MAX_VECTOR_BYTES = 64 << 20


def chunks_of(shortlist: DataFrame, chunk_index: DataFrame, on: str = "doc_id", **bounds) -> DataFrame:
    """All chunks of every shortlisted document. Of an index stored by document only the partitions of those are read."""
    index, wanted, keys = located(chunk_index, shortlist, on, bounds.get("counted"))
    return join_chosen(index, wanted, keys, salt_by=["id"], **bounds).drop(part_column(chunk_index) or "")


def knn_within(chunk_index: DataFrame, questions: DataFrame, shortlist: DataFrame, k: int = 50, qid: str = "qid",
               vec_col: str = "embedding", query_col: str = "qvec", max_rows: int = MAX_VECTOR_ROWS, **bounds) -> DataFrame:
    """The ``k`` nearest chunks of each shortlisted document: the shortlist row, then ``rank``, the chunk, ``distance``."""
    dim = questions.agg(F.max(F.size(query_col))).first()[0] or 1
    max_rows = min(max_rows, MAX_VECTOR_BYTES // (8 * dim))
    wanted = shortlist.join(questions.select(qid, query_col), qid)
    pairs = chunks_of(wanted, chunk_index, counted=shortlist, max_rows=max_rows, **bounds)
    # Distances are computed where the chunk is read; the vectors are dropped before anything is shuffled.
    near = pairs.withColumn("distance", squared_l2(F.col(vec_col), F.col(query_col))).drop(vec_col, query_col)
    order = Window.partitionBy(qid, "doc_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def token_budget(snippets: DataFrame, budget: int = 12_288, qid: str = "qid",
                 order: Sequence[str] = ("distance", "pos", "rank")) -> DataFrame:
    """Walk the snippets of a question by distance and stop at the first that pushes the token sum over ``budget``.

    Token counts are never negative, so the kept prefix is where the running sum is within the budget. A question
    has at most (search queries x 20 documents x 50 chunks) rows here, whatever the size of the tables.
    """
    so_far = Window.partitionBy(qid).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return snippets.withColumn("cum_tokens", F.sum("n_tokens").over(so_far)).filter(F.col("cum_tokens") <= budget)


def with_texts(kept: DataFrame, chunk_index: DataFrame, text: str = "document") -> DataFrame:
    """Add the text of the chunks that are left, ``id, doc_id`` of which find it in the index.

    ``kept`` is stored first: it is what a question may be answered from, and it is measured, then joined.
    """
    kept = cut_lineage(kept)
    part = part_column(chunk_index)
    texts = chunk_index.select(*([part] if part else []), "id", "doc_id", text)
    texts, wanted, keys = located(texts, kept)
    return join_chosen(texts, wanted, [*keys, "id"], salt_by=["id"]).drop(part or "").select(*kept.columns, text)


def reassemble(snippets: DataFrame, keys: Sequence[str] = ("qid", "doc_id")) -> DataFrame:
    """Text per question and document: its kept chunks in chunk order, joined with one blank."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "document")))
    return snippets.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["document"]), " ").alias("text"))
