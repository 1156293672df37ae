"""Question answering over the two indexes, for a whole table of questions at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.hooks import Completion, complete, normalize_reply
from folioscope.functions.messages import message
from folioscope.functions.rows import unnest
from folioscope.functions.text import n_tokens, query_list
from folioscope.operators.context import assemble_context, build_prompt
from folioscope.operators.embedding import embed
from folioscope.operators.knn import knn
from folioscope.operators.ranking import fuse, query_report, shortlist, shortlist_report
from folioscope.operators.snippets import knn_within, reassemble, token_budget, with_texts
from folioscope.operators.usage import usage_by
from folioscope.session import cut_lineage
from folioscope.sources.chunks import part_column

EXPAND_INSTRUCTIONS = (
    "Write search engine queries that would find the answer to the user's question. Separate them with ; and write at most 6. "
    "Reply with the queries alone, without an answer. "
    "For 'How tall is Mont Blanc?' a reply could be 'Mont Blanc height;highest peak of the Alps in metres'."
)


@dataclass
class AnswerConfig:
    """The defaults of the retrieval steps."""

    summary_results: int = 20
    chunk_results: int = 50
    threshold: float = 0.8
    budget: int = 12_288
    dim: int = 256
    vectors: Callable[[list[str]], Sequence[Sequence[float]]] | None = None
    encode: Callable[[str], Sequence] | None = None
    #: What both model calls take besides the messages, as ``{"temperature": 0.5}``.
    options: dict | None = None


def expansion_prompt(questions: DataFrame) -> DataFrame:
    """Add ``messages`` that ask for search queries."""
    return questions.withColumn("messages", F.array(message("system", F.lit(EXPAND_INSTRUCTIONS)), message("user", F.col("question"))))


def expand_questions(questions: DataFrame, fn: Completion, parallelism: int = 5, options: dict | None = None, log: str | None = None) -> DataFrame:
    """``qid, question, reply`` and usage: the reply of ``fn`` lists the search queries."""
    replies = complete(expansion_prompt(questions), fn, parallelism, options=options, log=log)
    return normalize_reply(replies, strict=True).withColumnRenamed("reply_content", "reply")


def split_queries(replies: DataFrame, reply: str = "reply", separator: str = ";", keys: Sequence[str] = ("qid",)) -> DataFrame:
    """``keys, qpos, query``: one row per search query, in order from 0."""
    return unnest(replies, list(keys), query_list(F.col(reply), separator), "qpos", "query")


def shortlist_docs(queries: DataFrame, summary_index: DataFrame, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """``qid, pos, doc_id, title, score`` from the search queries ``qid, qpos, query`` of every question."""
    asked = embed(queries, "query", cfg.dim, "qvec", cfg.vectors).select("qid", "qpos", "qvec")
    index = summary_index.select("id", F.col("metadata")["title"].alias("title"), "embedding")
    return shortlist_vectors(asked, index, cfg)


def shortlist_vectors(asked: DataFrame, index: DataFrame, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """The same from query vectors ``qid, qpos, qvec`` and an index ``id, title, embedding``."""
    hits = knn(index, asked, cfg.summary_results, carry=["title"])
    kept = shortlist(fuse(hits, attrs=["title"]), cfg.threshold)
    return kept.select("qid", "pos", F.col("id").alias("doc_id"), "title", "score")


def nearest_snippets(questions: DataFrame, shortlisted: DataFrame, chunk_index: DataFrame, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """The nearest chunks of every shortlisted document, by the question itself (its search queries found the documents).

    Token counts stand in the index or are made where a chunk is read; its text goes no further.
    """
    # Stored, so that the embedding function sees a question once.
    asked = cut_lineage(embed(questions, "question", cfg.dim, "qvec", cfg.vectors).select("qid", "qvec"))
    part = part_column(chunk_index)
    counted = F.col("n_tokens") if "n_tokens" in chunk_index.columns else n_tokens(F.col("document"), cfg.encode)
    rows = chunk_index.select(*([part] if part else []), "id", "doc_id", "chunk_id", counted.alias("n_tokens"), "embedding")
    return knn_within(rows, asked, shortlisted, cfg.chunk_results)


def retrieve_snippets(questions: DataFrame, shortlisted: DataFrame, chunk_index: DataFrame, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """Snippets within the token budget of each question, with the running token sum and without their text."""
    return token_budget(nearest_snippets(questions, shortlisted, chunk_index, cfg), cfg.budget)


def snippet_texts(questions: DataFrame, shortlisted: DataFrame, chunk_index: DataFrame, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """``qid, doc_id, text`` of what the budget leaves."""
    return reassemble(with_texts(retrieve_snippets(questions, shortlisted, chunk_index, cfg).select("qid", "doc_id", "id", "chunk_id"), chunk_index))


def context_of(questions: DataFrame, chosen: DataFrame, chunk_index: DataFrame, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """``qid, context`` from a shortlist that is cheap to read twice."""
    return assemble_context(chosen, snippet_texts(questions, chosen, chunk_index, cfg))


def answer_context(questions: DataFrame, queries: DataFrame, summary_index: DataFrame, chunk_index: DataFrame,
                   cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """``qid, context`` of every question that found documents."""
    # The shortlist is small beside the indexes and used twice; it is written once.
    return context_of(questions, cut_lineage(shortlist_docs(queries, summary_index, cfg)), chunk_index, cfg)


def answer_prompt(questions: DataFrame, queries: DataFrame, summary_index: DataFrame, chunk_index: DataFrame,
                  cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """``qid, messages`` ready for a model."""
    return build_prompt(answer_context(questions, queries, summary_index, chunk_index, cfg), questions)


def transcript(questions: DataFrame, summary_index: DataFrame, chunk_index: DataFrame, expand: Completion, reply: Completion,
               cfg: AnswerConfig = AnswerConfig(), parallelism: int = 5, log: str | None = None) -> DataFrame:
    """What the asker sees, ``qid, seq, role, content`` and usage: 0 the search queries, 1 the documents considered, 2 the answer.

    A question that found no documents is told so at 1 and has no 2. Messages that called no model have no usage. Both
    models are called once per question, and not again by a rerun with the same reply ``log``.
    """
    counts = ["completion_tokens", "prompt_tokens", "response_us"]
    expanded = cut_lineage(expand_questions(questions, expand, parallelism, cfg.options, log))
    queries = split_queries(expanded)
    chosen = cut_lineage(shortlist_docs(queries, summary_index, cfg))
    asked = build_prompt(context_of(questions, chosen, chunk_index, cfg), questions)
    replies = normalize_reply(complete(asked, reply, parallelism, options=cfg.options, log=log), strict=True)

    def said(rows: DataFrame, seq: int, role: str | Column, content: Column, usage: bool) -> DataFrame:
        none = F.lit(None).cast("bigint")
        return rows.select("qid", F.lit(seq).alias("seq"), (F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"),
                           *[(F.col(c) if usage else none).alias(c) for c in counts])

    # The text around the search queries, and what is said without documents.
    searched = query_report(queries).join(expanded.select("qid", *counts), "qid")
    considered = expanded.select("qid").join(shortlist_report(chosen), "qid", "left").withColumn("report", F.coalesce("report", F.lit("No relevant documents found.\n")))
    return (
        said(searched, 0, "system", F.concat(F.lit("Expanding your queries: \n "), F.col("queries"), F.lit("\n")), True)
        .unionByName(said(considered, 1, "system", F.col("report"), False))
        .unionByName(said(replies, 2, F.col("reply_role"), F.col("reply_content"), True))
    )


def answer(questions: DataFrame, summary_index: DataFrame, chunk_index: DataFrame, expand: Completion, reply: Completion,
           cfg: AnswerConfig = AnswerConfig(), parallelism: int = 5, log: str | None = None) -> DataFrame:
    """``qid, answer`` of every question, null if it found no documents, with the usage of its model calls added up."""
    said = transcript(questions, summary_index, chunk_index, expand, reply, cfg, parallelism, log)
    return usage_by(said, ["qid"], "response_us", F.max(F.when(F.col("seq") == 2, F.col("content"))).alias("answer"))
