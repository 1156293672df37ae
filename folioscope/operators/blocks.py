"""Blocks of a page: class, text, and the runs that must stay together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import block_text, content_text, n_tokens
from folioscope.operators.running import running_sums
from folioscope.session import has_rows

# The block types of each class. A type that is in none of them is dropped like the ignored ones.
IGNORED = ["unsupported", "breadcrumb", "child_database", "child_page", "column_list", "column", "embed", "file", "image",
           "link_preview", "link_to_page", "pdf", "mention", "synced_block", "table", "table_row", "template", "video"]
LIST_ITEMS = ["bulleted_list_item", "numbered_list_item", "to_do"]
HEADINGS = ["heading_1", "heading_2", "heading_3"]
CONTENT = ["bookmark", "callout", "code", "equation", "paragraph", "quote", "toggle"]
BREAKS = ["divider", "table_of_contents"]

STRIPE_ROWS = 8_192


def block_class(btype: Column) -> Column:
    return (
        F.when(btype.isin(CONTENT), "content").when(btype.isin(LIST_ITEMS), "list").when(btype.isin(HEADINGS), "heading")
        .when(btype.isin(BREAKS), "break").when(btype.isin(IGNORED), "ignored").otherwise("other")
    )


def run_kind(btype: Column) -> Column:
    """What a block must agree on with its neighbour to share a run: the list type, or any heading; null for others."""
    return F.when(btype.isin(LIST_ITEMS), btype).when(btype.isin(HEADINGS), "heading")


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Add ``class`` and ``kind``."""
    return blocks.withColumns({"class": block_class(F.col("btype")), "kind": run_kind(F.col("btype"))})


def read_blocks(blocks: DataFrame, encode: Callable[[str], Sequence] | None = None) -> DataFrame:
    """``page_id, pos, btype, text, n_tokens`` from rich text, captions and equations."""
    plain = block_text(F.col("rich_text"))
    text = (
        F.when(F.col("btype").isin(CONTENT), content_text(plain, F.col("caption"), F.col("expression")))
        .when(F.col("btype").isin(LIST_ITEMS + HEADINGS), plain).otherwise("")
    )
    return blocks.select("page_id", "pos", "btype", text.alias("text")).withColumn("n_tokens", n_tokens(F.col("text"), encode))


def split_long_pages(blocks: DataFrame, stripe_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of ordinary pages, and of pages with more than ``stripe_rows`` blocks if there are any (``pos`` counts from 0)."""
    beyond = blocks.filter(F.col("pos") >= stripe_rows)
    if not has_rows(beyond):
        return blocks, None
    long = beyond.select("page_id").distinct()
    return blocks.join(long, "page_id", "left_anti"), blocks.join(long, "page_id", "left_semi")


def _with_starts(rows: DataFrame, previous: Column) -> DataFrame:
    starts = F.col("kind").isNull() | ~F.col("kind").eqNullSafe(previous)
    return rows.withColumns({"_previous": previous, "_start": F.when(starts, F.col("pos"))})


def _units_of_pages(rows: DataFrame) -> DataFrame:
    page = Window.partitionBy("page_id").orderBy("pos")
    marked = _with_starts(rows.withColumn("_lag", F.lag("kind").over(page)), F.col("_lag")).drop("_lag")
    return marked.withColumn("unit", F.max("_start").over(page.rowsBetween(Window.unboundedPreceding, 0)))


def _units_of_stripes(rows: DataFrame, stripe_rows: int) -> DataFrame:
    """The same marks for pages too long for one task: per stripe of positions, then what earlier stripes hand on."""
    rows = rows.withColumn("_stripe", F.floor(F.col("pos") / stripe_rows))
    stripe = Window.partitionBy("page_id", "_stripe").orderBy("pos")
    earlier = Window.partitionBy("page_id").orderBy("_stripe")
    last = rows.groupBy("page_id", "_stripe").agg(F.max(F.struct("pos", "kind")).alias("_last"))
    handed = last.select("page_id", "_stripe", F.lag("_last.kind").over(earlier).alias("_handed"))
    marked = _with_starts(
        rows.withColumns({"_lag": F.lag("kind").over(stripe), "_first": F.row_number().over(stripe) == 1}).join(handed, ["page_id", "_stripe"]),
        F.when(F.col("_first"), F.col("_handed")).otherwise(F.col("_lag"))).drop("_lag", "_first", "_handed")
    opened = marked.groupBy("page_id", "_stripe").agg(F.max("_start").alias("_open"))
    opened = opened.select("page_id", "_stripe", F.max("_open").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    local = F.max("_start").over(stripe.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("unit", local).join(opened, ["page_id", "_stripe"]).withColumn("unit", F.coalesce("unit", "_open")).drop("_stripe", "_open")


def units(rows: DataFrame, stripe_rows: int | None = None) -> DataFrame:
    """Runs of list items and headings as one row each, every other block as its own row.

    ``page_id, unit, class, kind, previous, text, n_tokens``: ``unit`` is the position of the first block and
    ``previous`` the kind of the block before it. Without ``stripe_rows`` a page is one window partition.
    """
    marked = _units_of_pages(rows) if stripe_rows is None else _units_of_stripes(rows, stripe_rows)
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return marked.groupBy("page_id", "unit").agg(
        F.min("class").alias("class"), F.min("kind").alias("kind"),
        F.max(F.when(F.col("_start").isNotNull(), F.col("_previous"))).alias("previous"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.sum("n_tokens").alias("n_tokens"))


def group_runs(blocks: DataFrame, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """``page_id, run, kind, text, n_tokens``: the runs of each page, numbered from 1."""
    ordinary, long = split_long_pages(classify_blocks(blocks), stripe_rows)
    columns = ["page_id", "run", "kind", "text", "n_tokens"]
    order = Window.partitionBy("page_id").orderBy("unit")
    runs = units(ordinary).filter(F.col("kind").isNotNull()).withColumn("run", F.row_number().over(order).cast("bigint")).select(*columns)
    if long is not None:
        found = units(long, stripe_rows).filter(F.col("kind").isNotNull()).withColumn("run", F.lit(1).cast("bigint"))
        runs = runs.unionByName(running_sums(found, ["page_id"], ["page_id", "unit"], ["run"]).select(*columns))
    return runs
