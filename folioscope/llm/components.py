"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.llm.store import materialize

MAX_ROUNDS = 60


def _smallest_neighbour(links: DataFrame) -> DataFrame:
    """u, v, m: each link with the smallest of u and its neighbours. Combined in the map tasks, so a hub arrives reduced."""
    low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(materialize(low, "smallest-neighbours"), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _smallest_neighbour(down)
    rows = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return rows.where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, label): every node that has a link, with the smallest node it is connected to."""
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, now = None, _state(links)
    for _ in range(MAX_ROUNDS):
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        links = materialize(_small_star(_large_star(links)), "stars")
        before, now = now, _state(links)
    raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")


def _at_label(links: DataFrame, end: str, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias(end), F.col("label").alias("_l"))
    return links.join(known, end, "left").withColumn(end, F.coalesce("_l", end)).drop("_l")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of ``components`` after more links: known components take part as one node each, so rounds run over what is new alone."""
    between = materialize(components(_at_label(_at_label(links, "u", labels), "v", labels)), "merged-components")
    moved = labels.join(between.select(F.col("node").alias("label"), F.col("label").alias("_l")), "label", "left")
    return moved.select("node", F.coalesce("_l", "label").alias("label")).unionByName(between).distinct()
