"""Text columns: plain text of rich-text parts, token counts, sentence leads, query lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

TOKEN = r"\S+"
SENTENCE = r"[^.!?]+[.!?]?"


def join_parts(parts: Column, sep: str) -> Column:
    """``plain_text`` of every part joined with ``sep``; a missing text counts as empty, a null list stays null."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["plain_text"], F.lit(""))), sep)


def block_text(rich_text: Column) -> Column:
    """Text of a block: its parts with nothing between them, empty when there are none."""
    return F.coalesce(join_parts(rich_text, ""), F.lit(""))


def content_text(text: Column, caption: Column, expression: Column) -> Column:
    """Text of a content block with its caption before and its equation after it, each only when non-empty."""
    cap = F.coalesce(F.array_join(caption, ""), F.lit(""))
    expr = F.coalesce(expression, F.lit(""))
    # The markers around a caption and an equation, backslash and trailing blank included.
    return F.concat(
        F.when(F.length(cap) > 0, F.concat(F.lit("<caption> "), cap, F.lit(" <\\caption> "))).otherwise(""),
        F.coalesce(text, F.lit("")),
        F.when(F.length(expr) > 0, F.concat(F.lit("<equation> "), expr, F.lit(" <\\equation> "))).otherwise(""),
    )


def n_tokens(text: Column, encode: Callable[[str], Sequence] | None = None) -> Column:
    """Number of tokens. Default: runs of non-blank characters, in the JVM; ``encode`` swaps in a tokenizer.

    A tokenizer with a method ``counts`` (``tokens.Vocabulary``) is given a batch of texts at a time, any other a text a call.
    """
    if encode is None:
        return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), 0)), F.lit(0)).cast("bigint")

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        found = encode.counts(texts.to_pylist()) if hasattr(encode, "counts") else [0 if t is None else len(encode(t)) for t in texts.to_pylist()]
        return pa.array(found, pa.int64())

    return count(text)


def lead_sentences(text: Column, n: int = 8) -> Column:
    """The first ``n`` sentences, trimmed and joined with a blank: the offline stand-in for a written summary."""
    found = F.slice(F.regexp_extract_all(text, F.lit(SENTENCE), 0), 1, n)
    return F.array_join(F.transform(found, lambda s: F.trim(s)), " ")


def query_list(reply: Column, separator: str = ";") -> Column:
    """Split a reply into search queries; blanks, empties and repeats are kept as they come."""
    return F.split(reply, f"\\Q{separator}\\E", -1)


def strip(text: Column) -> Column:
    """Blanks of any script removed from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def two_decimals(value: Column) -> Column:
    """A score with two decimals, rounded from its exact binary value with exact halves to even.

    ``format_string`` rounds the shortest decimal form half up, which differs for values such as 0.575 and 1.125.
    """
    whole = F.floor(value)
    # The fraction in units of 2**-57, times 100, is the same as times 25 in units of 2**-55: it fits a bigint.
    scaled = ((value - whole) * float(2**57)).cast("bigint") * 25
    cents = F.shiftright(scaled, 55)
    rest, half = scaled - F.shiftleft(cents, 55), 2**54
    total = whole * 100 + cents + F.when((rest > half) | ((rest == half) & (cents % 2 == 1)), 1).otherwise(0)
    # Below 1/32 more bits than these may count, but no value lies half-way: the doubles 0.005 and 0.025 are just above, 0.015 just below.
    small = (value >= 0.005).cast("bigint") + (value > 0.015).cast("bigint") + (value >= 0.025).cast("bigint")
    total = F.when((value >= 0) & (value < 1 / 32), small).otherwise(total)
    return F.concat(F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
