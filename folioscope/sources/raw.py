"""Pages and blocks as the source describes them in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.properties import parse_properties
from folioscope.functions.rows import unnest

BODY = "rich_text array<struct<plain_text:string>>, caption array<string>, expression string"


def raw_pages(df: DataFrame, page: str = "page") -> DataFrame:
    """``page_id, last_edited, properties`` of page objects with ``id``, ``last_edited_time`` and ``properties``."""
    text = F.col(page)
    return df.select(F.get_json_object(text, "$.id").alias("page_id"), F.to_timestamp(F.get_json_object(text, "$.last_edited_time")).alias("last_edited"),
                     parse_properties(F.get_json_object(text, "$.properties")).alias("properties"))


def parse_block(block: Column) -> Column:
    """``btype, rich_text, caption, expression`` of a block object, which keeps its content under the key its ``type`` names."""
    btype = F.get_json_object(block, "$.type")
    body = F.from_json(F.call_function("get_json_object", block, F.concat(F.lit("$."), btype)), BODY)
    # Parts of a caption are objects like those of a text, or plain strings.
    caption = F.transform(body["caption"], lambda c: F.coalesce(F.when(c.startswith("{"), F.get_json_object(c, "$.plain_text")), c))
    return F.struct(btype.alias("btype"), body["rich_text"].alias("rich_text"), caption.alias("caption"), body["expression"].alias("expression"))


def raw_blocks(df: DataFrame, blocks: str = "blocks", page_id: str = "page_id") -> DataFrame:
    """``page_id, pos, btype, rich_text, caption, expression`` of pages that carry their blocks as an array of objects."""
    listed = unnest(df, [page_id], blocks, "pos", "_block")
    return listed.select(F.col(page_id).alias("page_id"), "pos", parse_block(F.col("_block")).alias("_b")).select("page_id", "pos", "_b.*")
