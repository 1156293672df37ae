"""Chat messages as structs and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The roles a message may have, the roles a reply may have, the fields of a message.
ROLES = ["system", "user", "assistant", "function"]
REPLY_ROLES = ["assistant", "function"]
FIELDS = ["role", "content", "timestamp"]


def message(role: str | Column, content: Column, timestamp: Column | None = None) -> Column:
    """A message; without a timestamp it gets the time of the query."""
    if isinstance(role, str):
        if role not in ROLES:
            raise ValueError(f"unknown role: {role}")
        role = F.lit(role)
    stamp = timestamp if timestamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.struct(role.alias("role"), content.alias("content"), stamp.alias("timestamp"))


def to_request(messages: Column) -> Column:
    """Messages reduced to what a model is sent: role and content."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def message_to_json(msg: Column) -> Column:
    return F.to_json(F.struct(*[msg[f].alias(f) for f in FIELDS]), {"ignoreNullFields": "false"})


def message_from_json(text: Column) -> Column:
    """Inverse of ``message_to_json``; broken JSON, an unknown key or a missing role or content is an error."""
    keys = F.json_object_keys(text)
    known = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in FIELDS]))) == 0
    whole = F.array_contains(keys, "role") & F.array_contains(keys, "content")
    parsed = F.from_json(text, "role string, content string, timestamp string", {"mode": "FAILFAST"})
    return F.when(known & whole, parsed).otherwise(F.raise_error(F.concat(F.lit("not a message: "), F.coalesce(text, F.lit("null")))))


def message_str(msg: Column) -> Column:
    return F.concat(msg["role"], F.lit(": "), msg["content"])
