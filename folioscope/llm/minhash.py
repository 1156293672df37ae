"""MinHash near-dedup by an inverted join of signature coordinates.

Documents are posted under (coordinate, value) pairs of their signatures and collisions are counted. Two signatures that
agree in ``MATCHES`` of ``COORDINATES`` places agree in one of any ``COORDINATES - MATCHES + 1`` of them, so a document is posted
under its rarest pairs only (prefix), and pairs that nobody else has are skipped: a document with enough of those cannot
match anything. What agrees often enough is confirmed on the full shingle sets.

Groups of copies cost what they hold, not its square. Equal sets are one node. In a posting list every node is first
compared with one leader, the one whose whole signature is most common in the corpus: the hub of its group. Confirmed
links make components, and from then on only nodes of different components are compared: first with a second leader by
hash, then all that are left, block by block of a list and in as many tasks as it has pairs of blocks: sizes, then signatures, then
full sets, so that only links come out of it, however many pairs of a large group are just not similar enough. A pair is left
out only if both are already in one component, or if fewer than ``MATCHES`` coordinates of their signatures agree; ``matches=1`` leaves
out those alone that agree in none.

Null or empty text has no shingles and is linked with nothing; fewer words than a shingle are one shingle. Rows without a
doc_id are linked with nothing. Rows that repeat a doc_id are linked with each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.llm.components import components, merged
from folioscope.llm.store import materialize, table
from folioscope.llm.words import LOWER, SPACES, Words, blocks, mix, pair, signed
from folioscope.operators.joins import join_chosen

SHINGLE = 4
SIMILAR_PERCENT = 80
COORDINATES = 32
#: A pair at the threshold agrees in 25.6 places on average, 2.3 the standard deviation; it has fewer than 15 once in 150,000 times.
MATCHES = 15
#: A list is compared in pairs of blocks of about so many nodes, or shingles if that is fewer nodes.
BLOCK_NODES = 256
BLOCK_SHINGLES = 1 << 20
PAIRS_AT_ONCE = 1 << 16
COLUMNS_AT_ONCE = 4_096
TASK = ("key", "a", "b")
_SEED = np.uint64(0x5851F42D4C957F2D)


def _shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of all rows, one row after another, and their offsets."""
    at, names = w.windows(k)
    row = w.row[at]
    first, counts = w.first(), w.counts()
    ends = np.cumsum(np.bincount(row, minlength=w.n_rows))
    sets = []
    for r, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
        if b > a:
            own = np.sort(names[a:b])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif counts[r]:
            one = np.full(1, counts[r], np.uint64)
            for name in w.names[first[r]:first[r] + counts[r]]:
                one = pair(one, name)
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets


def signatures(docs: DataFrame, k: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, two sums that name the set, and the signature."""
    factors = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * _SEED) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                names, ends = _shingle_sets(Words(data, offsets, SPACES, LOWER), k)
                size = np.diff(ends)
                full = np.flatnonzero(size)
                sums = np.zeros((2, hi - lo), np.uint64)
                values = np.zeros((hi - lo, coordinates), np.int32)
                if len(full):
                    begins = ends[full]
                    base = mix(names)
                    sums[0, full], sums[1, full] = np.add.reduceat(base, begins), np.add.reduceat(mix(base ^ _SEED), begins)
                    for i, f in enumerate(factors):
                        hashed = ((base * f) >> np.uint64(32)).astype(np.uint32)
                        values[full, i] = np.minimum.reduceat(hashed, begins).view(np.int32)
                flat = pa.array(values.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(signed(sums[0])), pa.array(signed(sums[1])),
                     pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * coordinates), flat)],
                    names=["doc_id", "n_shingles", "s1", "s2", "signature"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long, signature array<int>")


def shingle_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node and its full set, sorted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                names, ends = _shingle_sets(Words(data, offsets, SPACES, LOWER), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(names)))], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(sets, "node long, shingles array<long>")


def shared_pairs(nodes: DataFrame) -> DataFrame:
    """key, node, n: the coordinate-value pairs of every node that ``n`` > 1 nodes have. Counts are combined in the map tasks."""
    coordinate = F.posexplode("signature").alias("_i", "_v")
    key = F.shiftleft(F.col("_i").cast("long"), 32).bitwiseOR(F.col("_v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = nodes.select("node", coordinate).select("node", key.alias("key"))
    counts = materialize(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "pair-counts")
    return pairs.join(counts, "key")


def prefix_postings(shared: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """key, node, score: each node under its rarest coordinate-value pairs, those of one node alone left out.

    ``score`` adds up how common all pairs of the signature are.
    """
    shared = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    alone = F.lit(coordinates) - F.size("own")
    prefix = F.slice("own", F.lit(1), F.greatest(F.lit(0), F.lit(coordinates - matches + 1) - alone))
    score = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x.n)
    return shared.select("node", score.alias("score"), F.explode(prefix).alias("p")).select(F.col("p.key").alias("key"), "node", "score")


def _agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _enough(a: str, b: str, matches: int) -> Column:
    """Sizes near enough, and collisions in enough coordinates."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    near = (x * 100 >= y * SIMILAR_PERCENT) & (y * 100 >= x * SIMILAR_PERCENT)
    return near & (_agreeing(F.col(f"{a}.signature"), F.col(f"{b}.signature")) >= matches)


def with_leaders(postings: DataFrame, nodes: DataFrame, matches: int, order: Column) -> DataFrame:
    """a, b: every posted node with the leader of one of its lists, the one that agrees with it most.

    A leader that is in the node's component already is passed over.
    """
    lead = materialize(postings.groupBy("key").agg(F.max(F.struct(order.alias("o"), (-F.col("node")).alias("neg"), "label")).alias("top")), "leaders")
    found = (
        postings.join(lead, "key").select(F.col("node").alias("a"), "label", (-F.col("top.neg")).alias("b"), F.col("top.label").alias("other"))
        .where("a <> b and label <> other").select("a", "b").distinct())
    sides = nodes.select("node", "n_shingles", "signature")
    both = found.join(sides.alias("x"), F.col("a") == F.col("x.node")).join(sides.alias("y"), F.col("b") == F.col("y.node"))
    good = both.where(_enough("x", "y", matches)).select("a", "b", _agreeing(F.col("x.signature"), F.col("y.signature")).alias("m"))
    return good.groupBy("a").agg(F.max_by("b", F.struct("m", -F.col("b"))).alias("b"))


def contested(shared: DataFrame, labels: DataFrame, matches: int) -> DataFrame:
    """Nodes that share at least ``matches`` coordinates with other components; no other node can have a link left to find."""
    named = _labelled(shared.select("key", "node"), labels)
    mixed = materialize(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed-pairs")
    return named.join(mixed, "key").groupBy("node").count().where(F.col("count") >= matches).select("node")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by TASK, a whole group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in TASK]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        new[0] = tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        cuts = np.append(np.flatnonzero(new), batch.num_rows).tolist()
        if held and (not cuts or cuts[0] == 0):
            yield pa.Table.from_batches(held)
            held = []
        if cuts[0]:
            held.append(batch.slice(0, cuts[0]))
        for lo, hi in zip(cuts, cuts[1:]):
            if held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _may_match(group: pa.Table, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block pair that are worth a look at their sets.

    Sizes near enough, different components, collisions in enough coordinates; and this list must be the first that both are
    posted in, so that no pair is looked at twice.
    """
    node, label, mask, size, side, key = (group[c].to_numpy() for c in ("node", "label", "mask", "n_shingles", "side", "key"))
    signature = _matrix(group["signature"])
    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    inside = not len(other)
    if inside:
        other = own
    bit = np.int64(1) << (key[0] >> np.int64(32))
    out = []
    step = max(1, PAIRS_AT_ONCE // max(1, len(other)))
    for lo in range(0, len(own), step):
        a = own[lo:lo + step]
        near = (label[a, None] != label[other]) & (size[a, None] * 100 >= size[other] * SIMILAR_PERCENT) & (size[other] * 100 >= size[a, None] * SIMILAR_PERCENT)
        if inside:
            near &= a[:, None] < other
        i, j = np.nonzero(near)
        same = signature[a[i]] == signature[other[j]]
        enough = same.sum(axis=1) >= matches
        i, j, same = i[enough], j[enough], same[enough]
        shared = same @ (np.int64(1) << np.arange(signature.shape[1], dtype=np.int64)) & mask[a[i]] & mask[other[j]]
        first = (shared & -shared) == bit
        out.append((a[i[first]], other[j[first]]))
    x, y = (np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return node[x], node[y]


def _joined(label: dict, x: int) -> int:
    while label.setdefault(x, x) != x:
        x = label[x]
    return x


def _similar(group: pa.Table) -> list[tuple[int, int]]:
    """Of the pairs of a block pair those whose full sets are similar enough, as many as connect what they connect."""
    nodes, partners, sets = (group[c].combine_chunks() for c in ("node", "partners", "shingles"))
    names, size = sets.flatten().to_numpy(), sets.value_lengths().to_numpy()
    ids = nodes.to_numpy()
    place: dict[int, list[int]] = {}
    for r, n in enumerate(ids.tolist()):
        place.setdefault(n, []).append(r)
    pairs = [(r, q) for r, own in enumerate(partners.to_pylist()) for p in own or () for q in place.get(p, ())]
    if not pairs:
        return []
    x, y = np.array(pairs).T
    row = np.repeat(np.arange(len(ids)), size)
    if len(pairs) > len(ids):  # one product for all pairs, over the shingles that several rows have
        _, at, count = np.unique(names, return_inverse=True, return_counts=True)
        several = count[at] > 1
        row, at = row[several], np.unique(at[several], return_inverse=True)[1]
        common = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, int(at.max(initial=-1)) + 1, COLUMNS_AT_ONCE):
            part = (at >= lo) & (at < lo + COLUMNS_AT_ONCE)
            m = np.zeros((len(ids), COLUMNS_AT_ONCE), np.float32)
            m[row[part], at[part] - lo] = 1
            common += m @ m.T  # counts far below 2^24, exact
        shared = common[x, y].astype(np.int64)
    else:
        ends = np.cumsum(size)
        own = [names[e - n:e] for e, n in zip(ends.tolist(), size.tolist())]
        shared = np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in pairs], np.int64)
    good = shared * 100 >= (size[x] + size[y] - shared) * SIMILAR_PERCENT
    tree: dict[int, int] = {}
    links = []
    for a, b in zip(ids[x[good]].tolist(), ids[y[good]].tolist()):
        u, v = _joined(tree, a), _joined(tree, b)
        if u != v:
            tree[u] = v
            links.append((a, b))
    return links


def all_left(postings: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """u, v: links among all pairs of a list in different components.

    Lists of one component are left out first. The nodes of a list are cut into blocks, and every pair of blocks is a task of its own, so a
    list of any length is spread: signatures meet first, the sets only of the nodes that some pair is left of.
    """
    mixed = postings.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    known = postings.join(materialize(mixed.select("key", "n"), "mixed-lists"), "key")
    known = materialize(known.select("key", "node", "label", "n"), "left-postings")
    posted = known.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 32) as int))")).alias("mask"))
    info = materialize(posted.join(nodes.select("node", "n_shingles", "signature"), "node"), "left-nodes")
    weight = known.join(info.select("node", "n_shingles"), "node").groupBy("key").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("words"))
    cut = weight.select("key", F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_NODES), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int").alias("cut"))
    rows = known.select("key", "node", "label").join(cut, "key").join(info, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    spread = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    spread = spread.withColumns({"a": F.least("own", "_j"), "b": F.greatest("own", "_j"), "side": (F.col("own") > F.col("_j")).cast("int")})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            x, y = _may_match(group, matches)
            if len(x):
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                task = tuple(group[c][0].as_py() for c in TASK)
                lists = dict(zip(x[edge].tolist(), np.split(y, edge[1:])))
                out += [(*task, n, lists.get(n, ())) for n in {*x.tolist(), *y.tolist()}]
            if len(out) >= 4_096:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[*TASK, "node", "partners"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            links = _similar(group)
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    columns = [*TASK, "side", "node", "label", "mask", "n_shingles", "signature"]
    found = spread.select(*columns).repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(look, "key long, a int, b int, node long, partners array<long>")
    found = materialize(found, "pairs-left")
    return found.join(sets, "node").repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(compare, "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: the pairs whose full sets are similar enough. Sets of ``a`` travel to ``b``, so a hub's set is read in place."""
    a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * SIMILAR_PERCENT).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select("node", F.col("label").alias("_l"))
    return postings.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("_l", "node")).drop("_l")


def of_one_document(posted: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v: links between the sets of rows that share a doc_id."""
    name = F.struct("s1", "s2")
    several = posted.groupBy("doc_id").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo <> hi").select("doc_id")
    held = posted.select("doc_id", "s1", "s2").join(several, "doc_id").join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    return held.where("node <> doc_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    signed_docs = materialize(signatures(docs, k, coordinates), "signatures")
    posted = signed_docs.where("doc_id is not null and n_shingles > 0")
    nodes = materialize(
        posted.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "nodes")
    shared = materialize(shared_pairs(nodes), "shared-pairs")
    postings = materialize(prefix_postings(shared, coordinates, matches).withColumn("label", F.col("node")), "postings")
    # A list of one node links nothing.
    several = materialize(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    postings = materialize(postings.join(several, "key"), "shared-postings")
    # Sent to the texts while it is small, which then stay where they are; beyond that both sides are shuffled.
    involved = materialize(postings.select("node").distinct(), "posted-nodes")
    texts = join_chosen(docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text"), involved, "node")
    sets = materialize(shingle_sets(texts, k), "shingle-sets")

    labels = None
    for step in ("hub", "second", "rest"):
        if step == "hub":
            pairs = with_leaders(postings, nodes, matches, F.col("score"))
        elif step == "second":
            pairs = with_leaders(postings, nodes, matches, F.xxhash64("node", "key"))
        else:
            open_nodes = materialize(contested(shared, labels, matches), "contested-nodes")
            pairs = None
        new = all_left(postings.join(open_nodes, "node"), nodes, sets, matches) if pairs is None else confirmed(pairs, sets)
        links = materialize(new if labels is not None else new.unionByName(of_one_document(posted, nodes)), "near-links")
        labels = materialize(components(links) if labels is None else merged(labels, links), "labels")
        if step != "rest":
            postings = materialize(_labelled(postings, labels), "labelled-postings")

    of_set = nodes.select("s1", "s2", "node").join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("_c"))
    rows = signed_docs.select("doc_id", "n_shingles", "s1", "s2").join(of_set, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("_c"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose group keeps another; only the doc_ids that go take part in the join."""
    gone = materialize(near_duplicates(docs.select("doc_id", "text"), k).where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple], k: int = SHINGLE) -> list[tuple]:
    """The same rows from the definition, for tests."""
    import re

    sets = []
    for doc, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append((doc, {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    label = {d: d for d, _ in sets}
    change = True
    close = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y)]
    while change:
        change = False
        for a, b in close:
            low = min(label[a], label[b])
            change |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [(d, len(s), label[d], d is None or label[d] == d) for d, s in sets]
