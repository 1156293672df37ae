import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators.embedding import embed, term_counts
from folioscope.operators import knn as knn_module
from folioscope.operators.approximate import approximate_knn, recall
from folioscope.operators.knn import _without_spare_copies, knn, squared_l2


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(c, 0.3, (40, 6)) for c in range(5)]).astype(np.float32)
    points[50:90] = points[50]  # a large group of copies
    index = spark.createDataFrame([(f"d{i:03}", p.tolist()) for i, p in enumerate(points)] + [("none", None)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(i % 7, i // 7, rng.normal(i % 5, 1, 6).astype(np.float32).tolist()) for i in range(35)] + [(99, 0, None)],
                                  "qid int, qpos int, qvec array<float>")
    return index.repartition(4).cache(), asked.cache()


def brute(index, asked, k):
    ids = [(r.id, np.array(r.embedding, np.float64)) for r in index.collect() if r.embedding]
    out = set()
    for q in asked.filter("qvec is not null").collect():
        vec = np.array(q.qvec, np.float64)
        best = sorted((sum(float(s) for s in (x - vec) ** 2), i) for i, x in ids)[:k]
        out |= {(q.qid, q.qpos, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(best)}
    return out


def rows(df):
    return {(r.qid, r.qpos, r["rank"], r.id, round(r.distance, 9)) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 5, 60, 500])
def test_scan_is_exact(vectors, k):
    assert rows(knn(*vectors, k)) == brute(*vectors, k)


@pytest.mark.parametrize("k", [1, 60])
@pytest.mark.parametrize("block_bytes", [6 * 8, 64 * 6 * 8 // 4, 1 << 20])
def test_blocks_of_questions_give_the_same_answers(vectors, k, block_bytes):
    assert rows(knn(*vectors, k, block_bytes=block_bytes)) == brute(*vectors, k)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("block_bytes", [16, 1 << 20])
def test_rows_that_are_no_vectors_are_left_out(spark, parts, block_bytes):
    nan, inf = float("nan"), float("inf")
    index = spark.createDataFrame([(f"d{i}", [float(i), 1.0]) for i in range(8)] + [("nan", [nan, 1.0]), ("inf", [1.0, inf]), ("hole", [None, 1.0]), ("none", None)],
                                  "id string, embedding array<float>").repartition(parts)
    asked = spark.createDataFrame([(1, 0, [2.0, 1.0]), (2, 0, [nan, 1.0]), (3, 0, None), (4, 0, [7.0, 0.0])], "qid int, qpos int, qvec array<float>")
    got = sorted((r.qid, r["rank"], r.id) for r in knn(index, asked, 3, block_bytes=block_bytes).collect())
    assert got == [(1, 1, "d2"), (1, 2, "d1"), (1, 3, "d3"), (4, 1, "d7"), (4, 2, "d6"), (4, 3, "d5")]
    both = index.select(squared_l2(F.col("embedding"), F.lit([0.0, 1.0])).alias("d")).collect()
    assert sum(r.d is None for r in both) == 4


def test_only_usable_questions_are_collected_and_keys_count(spark, monkeypatch):
    sent = []
    scan = knn_module._scan

    def noted(index, queries, asked, *rest):
        sent.append(asked.num_rows)
        return scan(index, queries, asked, *rest)

    monkeypatch.setattr(knn_module, "_scan", noted)
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [5.0, 0.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([(f"{i}" * 1000, 0, [float(i), 0.0] if i < 4 else None) for i in range(9)], "qid string, qpos int, qvec array<float>")
    assert {(r.qid[0], r.id) for r in knn(index, asked, 1).collect()} == {("0", "a"), ("1", "a"), ("2", "a"), ("3", "a")}
    assert sent == [4]
    sent.clear()
    assert knn(index, asked, 1, block_bytes=2000).count() == 4
    assert len(sent) == 3 and sum(sent) == 4


def test_unequal_vectors_are_an_error(spark):
    index = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0, 3.0]), ("c", [2.0, 1.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, 0, [1.0, 2.0])], "qid int, qpos int, qvec array<float>")
    with pytest.raises(Exception, match="cannot be compared"):
        knn(index, asked, 2).collect()
    with pytest.raises(Exception, match="cannot be compared"):
        knn(index, asked.unionByName(spark.createDataFrame([(2, 0, [1.0])], asked.schema)), 2)
    with pytest.raises(Exception, match="cannot be compared"):
        index.select(squared_l2(F.col("embedding"), F.lit([0.0, 1.0]))).collect()


def test_empty_sides(spark, vectors):
    index, asked = vectors
    assert knn(index, asked.limit(0), 3).count() == 0
    assert knn(index.limit(0), asked, 3).count() == 0
    assert knn(index.limit(0), asked, 3, block_bytes=1).count() == 0


def test_carry(vectors):
    index, asked = vectors
    got = knn(index.withColumn("title", F.concat(F.lit("t "), "id")), asked, 2, carry=["title"]).collect()
    assert got and all(r.title == f"t {r.id}" for r in got)


def test_squared_l2(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<float>, b array<float>")
    assert df.select(squared_l2(F.col("a"), F.col("b")).alias("d")).first().d == 13.0


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "One two, ONE"), (2, ""), (3, None)], "id int, text string")
    out = {r.id: r.embedding for r in embed(docs, "text", 64).collect()}
    assert sorted(x for x in out[1] if x) == [1.0, 2.0] and len(out[1]) == 64 and not any(out[2]) and not any(out[3])
    assert {(r.id, r.tf) for r in term_counts(embed(docs, "text", 64), "id").collect()} == {(1, 1), (1, 2)}
    hooked = embed(docs.filter("id < 3"), "text", fn=lambda texts: [[len(t), 1.0] for t in texts]).orderBy("id").collect()
    assert [r.embedding for r in hooked] == [[12.0, 1.0], [0.0, 1.0]]


def test_spare_copies():
    x = np.array([[1, 2], [3, 4], [1, 2], [1, 2], [3, 4], [5, 6], [1, 2]], float)
    assert _without_spare_copies(x, 1).tolist() == [0, 1, 5]
    assert _without_spare_copies(x, 2).tolist() == [0, 1, 2, 4, 5]
    assert _without_spare_copies(x, 9).tolist() == list(range(7))
    same_mark = np.array([[0.0, 0.0], [0.0, -0.0], [0.0, 0.0]])
    assert _without_spare_copies(same_mark, 1).tolist() == [0]


def test_many_ties_and_copies(spark):
    """Whole-number vectors: most distances tie, a third of the rows are one vector, ids decide."""
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2, (600, 4)).astype(np.float32)
    points[::3] = [1, 1, 0, 0]
    ids = rng.permutation(600)
    index = spark.createDataFrame([(f"d{i:03}", p.tolist()) for i, p in zip(ids, points)], "id string, embedding array<float>").repartition(3).cache()
    asked = spark.createDataFrame([(i, 0, rng.integers(0, 3, 4).astype(np.float32).tolist()) for i in range(12)], "qid int, qpos int, qvec array<float>")
    for k in (1, 7, 150):
        assert rows(knn(index, asked, k)) == brute(index, asked, k)
    assert rows(knn(index, asked, 7, block_bytes=64)) == brute(index, asked, 7)


def test_approximate_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 16)) * 3
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(1_200, 16)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5_000, None), (5_001, [float("nan")] * 16)]
    index = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = index.where("id % 20 = 0 or id >= 5000").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    found, exact = approximate_knn(index, asked, 1.0, 20, ["qid"]).cache(), knn(index, asked, 20, ["qid"]).cache()
    n_exact, n_found = recall(found, exact, ["qid"]).agg(F.sum("n_exact"), F.sum("n_found")).first()
    assert n_exact == 60 * 20 and n_found >= 0.9 * n_exact
    # Distances are exact, ranks follow them, and nothing is found twice.
    known = {(r.qid, r.id): r.distance for r in exact.collect()}
    got = found.collect()
    assert all(known[r.qid, r.id] == r.distance for r in got if (r.qid, r.id) in known) and len({(r.qid, r.id) for r in got}) == len(got)
    assert approximate_knn(index, asked.where("qid < 0"), 1.0, 20, ["qid"]).count() == 0


def test_pairs_that_share_a_bucket_are_not_shuffled(spark):
    """One bucket holds every row: all pairs are met, and none but the answers leaves its task."""
    index = spark.createDataFrame([(i, [float(i % 97), 1.0]) for i in range(400)], "id long, embedding array<double>")
    asked = index.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    found = approximate_knn(index, asked, 1e6, 5, ["qid"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.qid, r["rank"], r.id, r.distance)
    assert sorted(map(key, found.collect())) == sorted(map(key, knn(index, asked, 5, ["qid"]).collect()))


def test_buckets_decide_which_rows_are_compared(spark):
    index = spark.createDataFrame([(i, [float(i), 0.0], [float(i // 4), float(i % 3 + 50)]) for i in range(24)], "id long, embedding array<double>, b array<double>")
    asked = index.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"), "b")
    got = sorted((r.qid, r["rank"], r.id) for r in knn_module.nearest(index, asked, 3, ["qid"], "id", "embedding", "qvec", [], bucket_col="b").collect())
    meet = lambda a, b: a // 4 == b // 4 or a % 3 == b % 3
    assert got == [(q, n + 1, i) for q in range(24) for n, i in enumerate(sorted(filter(lambda i: meet(q, i), range(24)), key=lambda i: (abs(i - q), i))[:3])]


def test_blocks_share_jobs_and_read_a_stored_index(spark, monkeypatch):
    """Blocks do not make or shuffle the index again, and are fewer jobs than they are."""
    scanned = []
    scan = knn_module._scan

    def noted(index, *rest):
        scanned.append("Exchange" in index._jdf.queryExecution().executedPlan().toString())
        return scan(index, *rest)

    monkeypatch.setattr(knn_module, "_scan", noted)
    monkeypatch.setattr(knn_module, "BLOCKS_AT_ONCE", 4)
    index = spark.createDataFrame([(i, [float(i)]) for i in range(64)], "id long, embedding array<double>").repartition(5)
    asked = index.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    got = knn(index, asked, 1, ["qid"], block_bytes=128)
    assert sorted((r.qid, r.id) for r in got.collect()) == [(i, i) for i in range(64)]
    assert len(scanned) == 8 and not any(scanned)


@pytest.mark.parametrize("rows_at_once", [3, 50])
def test_a_task_looks_at_a_bounded_number_of_rows(vectors, monkeypatch, rows_at_once):
    index, asked = vectors
    batch = index.toArrow().filter(np.array([r is not None for r in index.toArrow()["embedding"].to_pylist()]))
    seen, matrix = [], knn_module._matrix
    monkeypatch.setattr(knn_module, "ROWS_AT_ONCE", rows_at_once)
    monkeypatch.setattr(knn_module, "_matrix", lambda column, dim=None: seen.append(len(column)) or matrix(column, dim))
    questions = knn_module._Questions(np.array([r.qvec for r in asked.collect() if r.qvec], np.float64))
    best = knn_module._local_best([batch], questions, 5, "embedding", "id", [])
    assert max(seen) <= rows_at_once and best.num_rows == 5 * len(questions.vectors)


def test_blocks_share_a_pass_over_the_index(spark, vectors, monkeypatch):
    """Many small blocks read the index as often as a task may hold the answers of some of them, and are not collected one by one."""
    passes, collected = [], []
    together, arrow = knn_module._pass, type(vectors[0]).toArrow
    monkeypatch.setattr(knn_module, "_pass", lambda scans, tasks: passes.append(len(scans)) or together(scans, tasks))
    monkeypatch.setattr(knn_module, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(type(vectors[0]), "toArrow", lambda df: collected.append(1) or arrow(df))
    assert rows(knn(*vectors, 5, block_bytes=6 * 8)) == brute(*vectors, 5)
    assert len(passes) == 2 and sum(passes) > 30 and len(collected) == 1
    passes.clear()
    monkeypatch.setattr(knn_module, "BLOCK_ANSWERS", 50)
    assert rows(knn(*vectors, 5, block_bytes=6 * 8)) == brute(*vectors, 5)
    assert max(passes) <= 20 and len(passes) > 2  # a question here has five answers, and a block about one question


@pytest.mark.parametrize("scale", [1e-25, 1e-3, 1.0, 1e14, 1e16, 1e155])
@pytest.mark.parametrize("rows_at_once", [40, 4_096])
def test_candidates_hold_the_best_whatever_the_scale(monkeypatch, scale, rows_at_once):
    """Norms of very different size side by side, copies, and rows that differ by less than single precision shows."""
    monkeypatch.setattr(knn_module, "ROWS_AT_ONCE", rows_at_once)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) * np.repeat([1.0, 1e-3, 1e3, 1.0], 100)[:, None]
    x[300:] = x[0] + rng.normal(size=(100, 8)) * 1e-9
    x[350:370] = x[0]
    x *= scale
    q = np.vstack([x[::13], rng.normal(size=(10, 8)) * scale])
    batch = pa.record_batch({"id": pa.array(np.arange(len(x))), "embedding": pa.array(x.tolist())})
    with np.errstate(all="ignore"):
        best = knn_module._local_best([batch], knn_module._Questions(q), 7, "embedding", "id", [])
        truth = sum((x[None, :, d] - q[:, None, d]) ** 2 for d in range(8))
    want = [(i, j, truth[i, j]) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), truth[i]))[:7]]
    assert list(zip(best["_q"].to_pylist(), best["_id"].to_pylist(), best["distance"].to_pylist())) == want
