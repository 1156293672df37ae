"""Token-bounded chunks of a page.

A page becomes a list of operations: ``F`` hands a finished run (or the empty text before a block outside runs) to the
open chunk, ``C`` adds a content block, ``B`` closes the chunk. Packing folds over them:

* ``C`` closes the open chunk first when it would go over the bound.
* ``F`` that would go over the bound closes the chunk when it is larger than the chunk or the chunk has no tokens;
  otherwise, with more than two items in the chunk, all but the last are closed and the last moves on with the run.

Pages of ordinary length are one fold on one row. Longer pages are cut into stripes, whose chunk starts are found at the
same time (``stripes``), in rounds that grow with the logarithm of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.rows import unnest
from folioscope.operators.blocks import STRIPE_ROWS, classify_blocks, split_long_pages, units
from folioscope.operators.running import running_sums
from folioscope.operators.stripes import chunk_starts
from folioscope.session import cut_lineage

NO_TEXTS = "cast(array() as array<string>)"


def _operations(unit_rows: DataFrame) -> DataFrame:
    """Add ``ops``, the operations of each unit with a page-wide order key."""
    def op(name: str, order: Column, text: Column, size: Column) -> Column:
        return F.struct(order.alias("ord"), F.lit(name).alias("op"), text.alias("text"), size.alias("size"))

    first, second = F.col("unit").cast("bigint") * 2, F.col("unit").cast("bigint") * 2 + 1
    none = F.lit(0).cast("bigint")
    before = F.when(F.col("previous").isNull(), op("F", first, F.lit(""), none))
    own = (
        F.when(F.col("kind").isNotNull(), op("F", second, F.col("text"), F.col("n_tokens")))
        .when(F.col("class") == "content", op("C", second, F.col("text"), F.col("n_tokens")))
        .when(F.col("class") == "break", op("B", second, F.lit(""), none))
    )
    return unit_rows.select("page_id", "unit", F.array_compact(F.array(before, own)).alias("ops"))


def _closes_all(op: Column, tokens: Column, max_tokens: int) -> Column:
    over = tokens + op["size"] > max_tokens
    return (op["op"] == "B") | (over & ((op["op"] == "C") | (op["size"] > tokens) | (tokens == 0)))


def _fold_texts(ops: Column, max_tokens: int) -> Column:
    """Chunk texts of a whole page."""
    def lines(items: Column) -> Column:
        return F.array(F.array_join(items, "\n"))

    def step(s: Column, op: Column) -> Column:
        all_out = _closes_all(op, s["tokens"], max_tokens)
        most_out = (s["tokens"] + op["size"] > max_tokens) & (F.size(s["open"]) > 2)
        done = (
            F.when(all_out, F.when(F.size(s["open"]) > 0, F.concat(s["done"], lines(s["open"]))).otherwise(s["done"]))
            .when(most_out, F.concat(s["done"], lines(F.slice(s["open"], 1, F.size(s["open"]) - 1))))
            .otherwise(s["done"])
        )
        kept = F.when(all_out, F.expr(NO_TEXTS)).when(most_out, F.slice(s["open"], -1, 1)).otherwise(s["open"])
        tokens = F.when(all_out, F.lit(0).cast("bigint")).when(most_out, s["last"]).otherwise(s["tokens"])
        return F.struct(
            done.alias("done"),
            F.when(op["op"] == "B", kept).otherwise(F.concat(kept, F.array(op["text"]))).alias("open"),
            (tokens + op["size"]).alias("tokens"), op["size"].alias("last"))

    start = F.struct(F.expr(NO_TEXTS).alias("done"), F.expr(NO_TEXTS).alias("open"),
                     F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("last"))
    return F.aggregate(ops, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], lines(s["open"]))).otherwise(s["done"]))


def _pack_stripes(ops: DataFrame, max_tokens: int, stripe_rows: int) -> DataFrame:
    """``page_id, chunk_id, text`` of pages too long for one task."""
    flat = ops.withColumn("stripe", F.floor(F.col("unit") / stripe_rows))
    flat = unnest(flat, ["page_id", "stripe"], "ops", "at", "o").select("page_id", "stripe", "o.*")
    flat = cut_lineage(flat)
    starts = chunk_starts(flat.drop("text"), max_tokens).withColumn("chunk_id", F.lit(1).cast("bigint"))
    items = flat.filter(F.col("op") != "B").select("page_id", "ord", "text")
    marked = items.join(starts, ["page_id", "ord"], "left").fillna(0, ["chunk_id"])
    numbered = running_sums(marked, ["page_id"], ["page_id", "ord"], ["chunk_id"])
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return numbered.groupBy("page_id", "chunk_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")).select(
        "page_id", F.col("chunk_id").cast("int").alias("chunk_id"), "text")


def _pack(blocks: DataFrame, max_tokens: int, stripe_rows: int, drop_blank: bool) -> tuple[DataFrame, DataFrame | None]:
    ordinary, long = split_long_pages(classify_blocks(blocks), stripe_rows)
    # Windows, units and pages all cluster on page_id, so this is one shuffle.
    by_page = _operations(units(ordinary)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("unit", "ops"))).alias("units"))
    ops = F.flatten(F.transform("units", lambda u: u["ops"]))
    chunks = _fold_texts(ops, max_tokens)
    if drop_blank:
        chunks = F.filter(chunks, lambda c: F.trim(F.translate(c, "\n", " ")) != "")
    pages = by_page.select("page_id", chunks.alias("chunks"))
    striped = None if long is None else _pack_stripes(_operations(units(long, stripe_rows)), max_tokens, stripe_rows)
    if striped is not None and drop_blank:
        full = striped.filter(F.trim(F.translate("text", "\n", " ")) != "").withColumn("_n", F.lit(1).cast("bigint"))
        striped = running_sums(full, ["page_id"], ["page_id", "chunk_id"], ["_n"]).select("page_id", F.col("_n").cast("int").alias("chunk_id"), "text")
    return pages, striped


def pack_chunks(blocks: DataFrame, max_tokens: int = 1024, stripe_rows: int = STRIPE_ROWS, drop_blank: bool = False) -> DataFrame:
    """``page_id, chunk_id, text`` of blocks ``page_id, pos, btype, text, n_tokens``; ``chunk_id`` counts from 1."""
    pages, striped = _pack(blocks, max_tokens, stripe_rows, drop_blank)
    rows = unnest(pages, ["page_id"], "chunks", "at", "text").select("page_id", (F.col("at") + 1).alias("chunk_id"), "text")
    return rows if striped is None else rows.unionByName(striped)


def chunk_arrays(blocks: DataFrame, max_tokens: int = 1024, stripe_rows: int = STRIPE_ROWS, drop_blank: bool = False) -> DataFrame:
    """``page_id, chunks``: the chunks of a page as one value, for what needs the whole document in a row."""
    pages, striped = _pack(blocks, max_tokens, stripe_rows, drop_blank)
    if striped is None:
        return pages
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    return pages.unionByName(striped.groupBy("page_id").agg(F.transform(parts, lambda p: p["text"]).alias("chunks")))


def explode_chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk of ``docs`` (``id, chunks, ...``): ``id`` becomes ``document_chunk`` and ``doc_id`` the document."""
    rest = [c for c in docs.columns if c not in ("id", "chunks")]
    rows = unnest(docs, [F.col("id").alias("doc_id"), *rest], "chunks", "_at", "document")
    chunk = F.col("_at") + 1
    return rows.select(F.concat_ws("_", "doc_id", chunk).alias("id"), "doc_id", chunk.alias("chunk_id"), *rest, "document")
