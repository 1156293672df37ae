"""Hard negatives and whitening against the definition, with odd rows of every kind."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import negatives, whitening
from folioscope.llm.vectors import is_vector

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string, n long, anchor int, _block string"


@pytest.fixture
def embeddings(spark):
    """Rows (vec_id, vector, label) -> a table whose further columns clash with names that the operators use."""

    def make(rows: list[tuple]):
        return spark.createDataFrame([(*r, None, "i", 3, None, "b") for r in rows], SCHEMA).repartition(3)

    return make


def cloud(seed: int, n: int = 160, dim: int = 6, clusters: int = 5) -> list[tuple]:
    """Clustered vectors with copies, ties, repeated rows and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % clusters]], rng.randrange(3)) for i in range(n)]
    rows += [(n + i, rows[i % 7][1], 1) for i in range(60)]  # few vectors, many copies
    rows += [rows[3], rows[3], rows[0], (900, None, 1), (901, rows[1][1], None), (902, [float("nan")] * dim, 1), (903, [float("inf")] * dim, 2),
             (904, [None] * dim, 0), (905, [], 0), (906, [0.0] * dim, 2), (907, [0.0] * dim, 1), (910, [0.0] * dim, 2), (None, rows[2][1], 1), (7, rows[9][1], 2)]
    rng.shuffle(rows)
    return rows


def expected(docs) -> Counter:
    con = duckdb.connect()
    con.register("embeddings", docs.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").toArrow())
    return Counter(tuple(r) for r in con.execute(negatives.SQL).fetchall())


def mined(docs, is_anchor: str = "id % 50 = 0", **sizes) -> Counter:
    rows = negatives.prepared(docs)
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return Counter(tuple(r) for r in negatives.hard_negatives(rows, is_anchor, **sizes).collect())


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"tree_rows": 20, "leaf": 3}), (3, {"tree_rows": 16, "leaf": 2, "block_bytes": 200})])
def test_negatives_against_the_definition(embeddings, seed, sizes):
    docs = embeddings(cloud(seed))
    want = expected(docs)
    assert mined(docs, **sizes) == want
    assert len(want) > 20


def test_negatives_of_one_vector_that_most_rows_share(embeddings):
    same = [0.5, 0.5, 0.25]
    rows = [(i, same, i % 2) for i in range(300)] + [(300 + i, [0.4, 0.5 - i / 100, 0.2], 2) for i in range(20)]
    docs = embeddings(rows)
    assert mined(docs, tree_rows=32, leaf=4) == expected(docs)


@pytest.mark.parametrize("rows", [[], [(0, None, 1), (50, [], 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [0.75], 2)]])
def test_negatives_of_next_to_nothing(embeddings, rows):
    assert not mined(embeddings(rows))


def test_vectors_of_unequal_length_are_an_error(embeddings):
    docs = embeddings([(0, [1.0, 2.0], 1), (1, [1.0], 1)])
    with pytest.raises(ValueError, match="1 to 2 entries"):
        mined(docs)
    with pytest.raises(ValueError, match="1 to 2 entries"):
        whitening.fit(whitening.fit_list(whitening.prepared(docs)))


def test_cover_tree_covers_its_points():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(200, 5)), rng.normal(size=(200, 5)) * 0.01 + 3, np.zeros((50, 5))])
    order, tree = negatives.cover_tree(points, leaf=4)
    assert sorted(order) == list(range(len(points)))
    x = points[order]
    for centre, radius, lo, hi, child, children in zip(*(tree[c] for c in ("centre", "radius", "start", "stop", "child", "children"))):
        away = np.sqrt(((x[lo:hi] - x[centre]) ** 2).sum(axis=1))
        assert lo <= centre < hi and away.max() <= radius + 1e-12
        if children:
            kids = slice(child, child + children)
            assert tree["start"][kids][0] == lo and tree["stop"][kids][-1] == hi and (tree["radius"][kids] <= negatives.SHRINK * radius + 1e-12).all()


def test_descent_skips_clusters_out_of_reach(monkeypatch):
    """Anchors near one of many far clusters score few of the candidates."""
    rng = np.random.default_rng(5)
    centres = np.round(rng.normal(size=(40, 8)) * 2_000)
    x = np.round(np.repeat(centres, 25, axis=0) + rng.normal(size=(1_000, 8)) * 5).astype(np.int64)
    order, nodes = negatives.cover_tree(negatives.augmented(x, float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max())), leaf=25)
    tree = negatives._Tree(1, np.arange(1_000), x[order], nodes)
    scored, exact = [], negatives.products
    monkeypatch.setattr(negatives, "products", lambda q, p: scored.append(len(q) * len(p)) or exact(q, p))
    q = x[::100]
    best = negatives.Best(len(q), 5)
    negatives.descend(tree, q, np.full(len(q), -1), np.full((len(q), 1), -np.inf), np.full((len(q), 1), np.inf), best, np.arange(len(q))[:, None])
    assert sum(scored) < 0.5 * len(q) * len(x)
    want = [sorted(row, reverse=True)[:5] for row in (q @ x.T).tolist()]
    assert best.score.reshape(-1, 5).tolist() == want


def test_products_beyond_double_precision():
    q, x = np.array([[2**30 + 1, 3]]), np.array([[2**30 + 1, -1], [5, 7]])
    assert negatives.products(q, x).tolist() == [[(2**30 + 1) ** 2 - 3, 5 * (2**30 + 1) + 21]]


# Whitening


def whitened(docs, components: int = 4):
    rows = whitening.prepared(docs)
    vectors = whitening.fit_list(rows)
    w = whitening.fit(vectors, components)
    return w, vectors, whitening.whiten(rows, w)


def test_whitening_against_the_definition(embeddings):
    rows = cloud(6)
    docs = embeddings(rows)
    w, vectors, got = whitened(docs)
    floats = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v, _ in rows]
    want = sorted(whitening.brute_force(floats), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))
    have = sorted(((r.vec_id, k + 1, w.n, r.deviation, abs(y), w.values[k] / w.trace) for r in got.collect() for k, y in enumerate(r.whitened)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))
    assert [r[:4] for r in have] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in have], [r[4:] for r in want], rtol=1e-9, atol=1e-9)
    assert whitening.identity_error(vectors, w) < 1e-9


def test_polarised_sums_are_exact(spark):
    """Totals beyond 64 bits, and values beyond what the limbs hold."""
    for scale in (1, 10**6, 10**13):
        rng = random.Random(7)
        rows = [([rng.randrange(-scale, scale + 1) for _ in range(3)],) for _ in range(40)]
        df = spark.createDataFrame(rows, "x array<long>").repartition(3)
        n, sums = whitening._column_sums(df, 3)
        assert n == 40 and sums == [sum(r[0][k] for r in rows) for k in range(3)]
        got = whitening.polarised(df, n, sums)
        z = [[n * v - s for v, s in zip(r[0], sums)] for r in rows]
        assert got == {(a, b): sum((r[a] + (r[b] if a != b else 0)) ** 2 for r in z) for a in range(3) for b in range(a, 3)}


def test_squares_in_limbs_are_exact():
    rng = np.random.default_rng(8)
    v = rng.integers(-(2**45), 2**45, size=(40_000, 2))
    assert whitening._squares(v) == [sum(int(y) ** 2 for y in c) for c in v.T.tolist()]


def test_whitening_without_variance(embeddings):
    w, vectors, got = whitened(embeddings([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)]))
    assert w.n == 1 and [(r.vec_id, r.deviation, r.whitened) for r in got.orderBy("vec_id").collect()] == [(1, 0, [None, None]), (2, 0, [None, None])]
    assert whitening.identity_error(vectors, w) is None
    # One dimension follows the other: a single component has a variance.
    w, vectors, got = whitened(embeddings([(i, [float(i), 2.0 * i], 0) for i in range(5)]))
    assert [y is None for y in got.first().whitened] == [False, True] and whitening.identity_error(vectors, w) < 1e-9


def test_whitening_of_nothing(embeddings):
    docs = embeddings([(1, None, 0), (2, [None], 1), (3, [], 1)])
    assert whitening.fit(whitening.fit_list(whitening.prepared(docs))) is None


def test_whitened_query_of_an_empty_table(spark, tmp_path, embeddings):
    embeddings([]).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert not whitening.op13_polarised_whitening(spark, str(tmp_path)).collect()
    assert not negatives.op11_cover_tree_negatives(spark, str(tmp_path)).collect()


def test_vectors(spark):
    rows = [([1.0, 2.0], True), ([], False), (None, False), ([None, 1.0], False), ([float("nan")], False), ([float("-inf")], False)]
    df = spark.createDataFrame(rows, "v array<float>, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", is_vector(F.col("v"))).collect())
