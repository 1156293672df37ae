"""Documents of a question: reciprocal-rank fusion, order, relative-threshold cut, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import two_decimals


def reciprocal_rank(rank: Column) -> Column:
    """``1 / rank`` with ranks from 1 and no smoothing constant."""
    return F.lit(1.0) / rank


def fuse(hits: DataFrame, qid: str = "qid", doc: str = "id", attrs: Sequence[str] = ()) -> DataFrame:
    """Sum of reciprocal ranks per question and document, with the place and the attributes of its first hit.

    A group has one row per search query of the question, all of which come from one reply. They are added in query
    order because doubles added in another order can differ in the last bit, which the cut would notice.
    """
    hit = F.struct("qpos", "rank")
    return (
        hits.groupBy(qid, doc)
        .agg(F.array_sort(F.collect_list(hit)).alias("_hits"), *[F.min_by(a, hit).alias(a) for a in attrs])
        .select(qid, doc, *attrs, F.col("_hits")[0]["qpos"].alias("first_qpos"), F.col("_hits")[0]["rank"].alias("first_rank"),
                F.aggregate("_hits", F.lit(0.0), lambda total, h: total + reciprocal_rank(h["rank"])).alias("score"))
    )


def order_shortlist(fused: DataFrame, qid: str = "qid") -> DataFrame:
    """Add ``pos`` from 1: by score, equal scores in the order they were first seen."""
    order = Window.partitionBy(qid).orderBy(F.desc("score"), "first_qpos", "first_rank")
    return fused.withColumn("pos", F.row_number().over(order))


def cut_shortlist(ordered: DataFrame, t: float = 0.8, qid: str = "qid") -> DataFrame:
    """Keep scores of at least ``top - t * (top - bottom)``; the top row always stays."""
    whole = Window.partitionBy(qid)
    top, bottom = F.max("score").over(whole), F.min("score").over(whole)
    kept = ordered.withColumn("_floor", top - F.lit(float(t)) * (top - bottom)).filter(F.col("score") >= F.col("_floor"))
    return kept.drop("_floor")


def shortlist(fused: DataFrame, t: float = 0.8, qid: str = "qid") -> DataFrame:
    return cut_shortlist(order_shortlist(fused, qid), t, qid)


def shortlist_report(kept: DataFrame, qid: str = "qid") -> DataFrame:
    """One text per question: how many documents are considered, then a line ``score, title`` for each."""
    # The wording of the head and the form of a line.
    line = F.concat(two_decimals(F.col("score")), F.lit(" \t "), F.coalesce("title", F.lit("None")), F.lit("\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda r: r["line"]), "")
    head = F.format_string("Considering the following %d relevant documents.\n", F.count(F.lit(1)))
    return kept.groupBy(qid).agg(F.concat(head, lines).alias("report"))


def query_report(queries: DataFrame, qid: str = "qid") -> DataFrame:
    """The search queries of a question in one text, in order, joined with ``;``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("qpos", "query"))), lambda r: r["query"])
    return queries.groupBy(qid).agg(F.array_join(listed, ";").alias("queries"))
