"""Ingest: from edited pages to the chunk and the summary index."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions.hooks import Completion
from folioscope.functions.properties import merge_metadata
from folioscope.operators.blocks import read_blocks
from folioscope.operators.embedding import embed
from folioscope.operators.packing import pack_chunks
from folioscope.operators.summary import base_metadata, summarize
from folioscope.schema import CHUNK_INDEX, MARKS, SEEN, SUMMARY_INDEX
from folioscope.session import cut_lineage
from folioscope.sources.pages import changed_by_loader, changed_pages, fetch_pages, page_blocks, project_metadata
from folioscope.sources.tables import PARTS, drop_replaced, latest_per_key, open_index, read_mark, stamp, stamp_text, store_batch, write_batch, write_mark


@dataclass
class LoaderConfig:
    """How one source is read. ``metadata`` maps keys of the index to property names; edits are stamped to ``granularity_s``."""

    title: str = "Title"
    edited: str | None = "Last edited time"
    metadata: dict[str, str] = field(default_factory=dict)
    max_tokens: int = 1024
    max_blocks: int | None = None
    granularity_s: int = 60
    encode: Callable[[str], Sequence] | None = None


@dataclass
class IndexConfig:
    """How vectors and summaries are made."""

    dim: int = 256
    vectors: Callable[[list[str]], Sequence[Sequence[float]]] | None = None
    summary: Completion | None = None
    parallelism: int = 5
    #: What a summary call takes besides the messages, as ``{"temperature": 0.6}``.
    options: dict | None = None
    #: Parts of a new index, see ``sources.tables``.
    parts: int = PARTS


def described_pages(pages: DataFrame, cfg: LoaderConfig, lookup: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """``scope, id, title, last_edited_time, metadata`` of pages."""
    return project_metadata(pages, cfg.metadata, cfg.title, cfg.edited, lookup, scope).withColumnRenamed("page_id", "id")


def packed_chunks(blocks: DataFrame, cfg: LoaderConfig) -> DataFrame:
    """``page_id, chunk_id, text`` of blocks."""
    return pack_chunks(read_blocks(blocks, cfg.encode), cfg.max_tokens)


def chunked_docs(described: DataFrame, packed: DataFrame) -> DataFrame:
    """Described pages with their chunks as an array; a page without blocks has none."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    arrays = packed.groupBy(F.col("page_id").alias("id")).agg(F.transform(parts, lambda p: p["text"]).alias("chunks"))
    return described.join(arrays, "id", "left").withColumn("chunks", F.coalesce("chunks", F.expr("cast(array() as array<string>)")))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Index rows without vectors of ``id, doc_id, chunk_id, title, last_edited_time, metadata, document``.

    User metadata overwrites the built-in keys, the ids of document and chunk included: look-ups by document and the
    order of snippets read the merged values. A chunk id that is no number leaves the chunk's own.
    """
    merged = merge_metadata(base_metadata("title", "last_edited_time", "doc_id", "chunk_id"), F.col("metadata"))
    return chunks.withColumn("metadata", merged).select(
        "id", F.col("metadata")["doc_id"].alias("doc_id"), F.coalesce(F.col("metadata")["chunk_id"].try_cast("int"), F.col("chunk_id").cast("int")).alias("chunk_id"), "metadata", "document")


def build_chunk_index(described: DataFrame, packed: DataFrame, index: IndexConfig = IndexConfig()) -> DataFrame:
    """Chunk index rows. Chunks stay rows throughout, so a page may have any number of them."""
    named = packed.select(F.concat_ws("_", "page_id", "chunk_id").alias("id"), F.col("page_id").alias("doc_id"), "chunk_id",
                          F.col("text").alias("document"))
    rows = chunk_rows(named.join(described.withColumnRenamed("id", "doc_id"), "doc_id"))
    return embed(rows, "document", index.dim, fn=index.vectors)


def build_summary_index(docs: DataFrame, index: IndexConfig = IndexConfig(), log: str | None = None) -> DataFrame:
    """Summary index rows of ``docs`` (see ``chunked_docs``)."""
    return embed(summarize(docs, index.summary, index.parallelism, index.options, log=log), "document", index.dim, fn=index.vectors)


def index_rows(kind: str, described: DataFrame, packed: DataFrame, index: IndexConfig, log: str | None = None) -> DataFrame:
    if kind == "chunk":
        return build_chunk_index(described, packed, index)
    if kind == "summary":
        return build_summary_index(chunked_docs(described, packed), index, log)
    raise ValueError(f"unknown index kind: {kind}")


SCHEMAS = {"chunk": CHUNK_INDEX, "summary": SUMMARY_INDEX}


def feed_indexes(pages: DataFrame, blocks: DataFrame, root: str, kinds: Sequence[str], cfg: LoaderConfig = LoaderConfig(),
                 index: IndexConfig = IndexConfig(), lookup: DataFrame | None = None, scope: Sequence[str] = (), drop_older: bool = False) -> None:
    """Upsert the given pages, one row an id, into every index below ``root``. Pages are described and packed once for all of them, and
    the rows of an index are stored once, as its own; ``drop_older`` first removes what batches before the last one replaced.

    Replies of the summary model are logged below ``root``, so pages that are fed again after a failure are not paid for again.
    """
    described = cut_lineage(described_pages(pages, cfg, lookup, scope))
    ids = described.select(*scope, F.col("id").alias("page_id"))
    described = described.drop(*scope)
    packed = packed_chunks(page_blocks(blocks, ids, cfg.max_blocks, [*scope, "page_id"]), cfg)
    for kind in sorted(kinds):  # the chunk index first: its rows are what summaries are made of
        if drop_older:
            drop_replaced(described.sparkSession, f"{root}/{kind}")
        batch = store_batch(index_rows(kind, described, packed, index, f"{root}/replies"), f"{root}/{kind}", parts=index.parts, gather=False)
        write_batch(batch, f"{root}/{kind}", parts=index.parts)
        if kind == "chunk":
            packed = batch.rows.select(F.regexp_replace("id", "_[^_]*$", "").alias("page_id"), "chunk_id", F.col("document").alias("text"))


@dataclass
class Source:
    """One loader: its pages and blocks, and the kinds of index it feeds."""

    name: str
    pages: DataFrame
    blocks: DataFrame
    config: LoaderConfig = field(default_factory=LoaderConfig)
    indexes: Sequence[str] = ("summary", "chunk")


PAGE = ["loader", "page_id"]


def _sums(rows: DataFrame, text: Column) -> DataFrame:
    """``loader, page_id, content``: what a page's rows hold, in any order. Rows are added up in the map tasks, however many a page has."""
    hashes = [F.xxhash64(F.lit(seed), text).cast("decimal(20,0)") for seed in (0, 1)]
    return rows.groupBy(*PAGE).agg(F.concat_ws(":", F.count("*"), *(F.sum(h).cast("string") for h in hashes)).alias("content"))


def page_contents(pages: DataFrame, blocks: DataFrame, ids: DataFrame, max_blocks: int | None = None) -> DataFrame:
    """``loader, page_id, content``: a 128-bit hash of the properties and one of the blocks of each listed page."""
    plain = {"ignoreNullFields": "false"}
    own = _sums(fetch_pages(pages, ids, PAGE), F.to_json(F.struct(F.array_sort(F.map_entries("properties"))), plain))
    held = page_blocks(blocks, ids, max_blocks, PAGE)
    held = _sums(held, F.to_json(F.struct(*(F.col(f"`{c}`") for c in held.columns if c not in PAGE)), plain))
    both = own.join(held.withColumnRenamed("content", "_blocks"), PAGE, "left")
    return both.select(*PAGE, F.concat_ws("/", "content", F.coalesce("_blocks", F.lit(""))).alias("content"))


def _alike(sources: Sequence[Source]) -> list[list[Source]]:
    """Sources that are read in the same way, together."""
    groups: list[list[Source]] = []
    for source in sources:
        same = next((g for g in groups if g[0].config == source.config and list(g[0].indexes) == list(source.indexes)), None)
        same.append(source) if same else groups.append([source])
    return groups


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def run_ingest(spark: SparkSession, sources: Sequence[Source], root: str, index: IndexConfig = IndexConfig()) -> dict[str, bool]:
    """Feed every source's edited pages to its indexes below ``root``; says which sources had any.

    Sources with equal settings are read together, each row against the mark of its own loader, so the number of jobs
    grows with the settings that differ and not with the sources. Of a page id that several of them edited the row of the last source stays.

    The mark of a source moves to the newest edit that was read, and only after all its indexes are written, so a run
    that fails is repeated from the old mark; repeated upserts change nothing. Since stamps are no finer than the source's
    granularity, the next run looks back by that much and leaves out only pages whose stamp and content are what it has
    read: neither another page nor another edit of the same page is lost when it shows up later with the stamp of the mark.
    """
    fed: dict[str, bool] = {}
    for group in _alike(sources):
        fed |= _run_together(spark, group, root, index)
    return {s.name: fed[s.name] for s in sources}


def _run_together(spark: SparkSession, sources: Sequence[Source], root: str, index: IndexConfig) -> dict[str, bool]:
    cfg = sources[0].config
    pages = _union([s.pages.withColumns({"loader": F.lit(s.name), "_place": F.lit(i)}) for i, s in enumerate(sources)])
    blocks = _union([s.blocks.withColumn("loader", F.lit(s.name)) for s in sources])
    names = spark.createDataFrame([(s.name,) for s in sources], "loader string")
    back = F.expr(f"interval {cfg.granularity_s} seconds")
    marks = cut_lineage(read_mark(open_index(spark, f"{root}/marks", MARKS), names))  # a row a source
    # Every loader's own mark decides; the earliest of them, a constant, reaches the scans.
    earliest = marks.select(stamp_text(F.min(F.col("ts") - back))).first()[0]
    after = marks.select("loader", (F.col("ts") - back).alias("ts"))
    recent = changed_pages(pages, stamp(F.lit(earliest)), keep=["loader", "_place", "last_edited"])
    changed = cut_lineage(changed_by_loader(recent, after))
    seen = open_index(spark, f"{root}/seen", SEEN).join(F.broadcast(names), "loader")
    stamped = seen.select(*PAGE, F.col("last_edited").cast(changed.schema["last_edited"].dataType).alias("last_edited"), F.col("content").alias("_read"))
    again = cut_lineage(changed.join(stamped, [*PAGE, "last_edited"]))
    same = again.join(page_contents(pages, blocks, again, cfg.max_blocks), PAGE).filter(F.col("content") == F.col("_read"))
    ids = cut_lineage(changed.join(same.select(*PAGE, "last_edited"), [*PAGE, "last_edited"], "left_anti"))
    newest = ids.groupBy("loader").agg(F.max("last_edited").cast("timestamp").alias("newest"))
    moved = cut_lineage(marks.join(newest, "loader").select("loader", F.greatest("ts", "newest").alias("ts")))
    fed = {r.loader for r in moved.select("loader").collect()}
    if fed:
        # Before the pages are fed: what changes in between differs from what is noted and is read again.
        recent = ids.join(moved, "loader").filter(F.col("last_edited") > F.col("ts") - back).drop("ts")
        noted = cut_lineage(recent.join(page_contents(pages, blocks, recent, cfg.max_blocks), PAGE))
        last = latest_per_key(ids.select("page_id", "loader", "_place").distinct(), "page_id", ["_place"])
        feed_indexes(fetch_pages(pages, last, PAGE).drop("_place"), blocks, root, sources[0].indexes, cfg, index, pages, ["loader"])
        noted = noted.select(*PAGE, F.col("last_edited").cast("timestamp"), "content")
        write_batch(latest_per_key(noted, PAGE, ["last_edited"]), f"{root}/seen", PAGE)
        write_mark(moved, f"{root}/marks")
    return {s.name: s.name in fed for s in sources}


def open_indexes(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {kind: open_index(spark, f"{root}/{kind}", schema) for kind, schema in SCHEMAS.items()}
