import numpy as np
import pytest

from gaugeflow.llm import registry, vectors


def brute(rows, asked, k=5):
    """{query: [(vec_id, score)]} over all rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in asked:
        q = np.repeat(x[ids == i][:1], len(x), axis=0)
        score = vectors.cosines(q, x)
        order = [o for o in np.lexsort((ids, -score)) if ids[o] != i][:k]
        out[i] = [(int(ids[o]), float(score[o])) for o in order]
    return out


def found(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, part STRING")


def search(spark, rows, every, **more):
    good = vectors.usable(table(spark, rows), "vec_id", "embedding")
    return found(vectors.search(good, good.where(f"vec_id % {every} = 0"), **more))


@pytest.mark.parametrize("block", [4096, 40])
def test_one_part_is_exact(spark, block):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 8)).astype(np.float32)
    x[100:200] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert search(spark, rows, 10, parts=1, block=block) == brute(rows, range(0, 300, 10))


def test_parts_are_balanced():
    draw = np.random.default_rng(2)
    x = vectors._unit(np.concatenate([draw.normal(c, 1, (n, 16)) for c, n in ((0, 600), (3, 200), (-3, 100))]))
    part = vectors.balanced_parts(x, vectors.nearest(x, 10), 9)
    assert np.bincount(part, minlength=9).max() <= np.ceil(900 / 9 * 1.1)


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (10, [1.0, 1.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (20, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (None, [1.0, 0.0]),
            (8, [3.0, 0.0]), (8, [3.0, 0.0])]
    result = search(spark, rows, 10)
    assert set(result) == {0, 10}
    assert [i for i, _ in result[0]] == [1, 8, 8, 10]
    assert search(spark, [], 10) == {}
    assert search(spark, [(0, [1.0])], 10) == {}


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    right = brute(rows, [i for i, _ in rows if i % 50 == 0])
    result = found(registry.QUERIES["op7_nearest"](spark, sf))
    assert set(result) == set(right)
    hits = [len({i for i, _ in right[q]} & {i for i, _ in result[q]}) / 5 for q in right]
    assert np.mean(hits) >= 0.9
    scores = {q: dict(v) for q, v in right.items()}
    for q, near in result.items():
        assert len(near) == 5
        for i, s in near:
            assert abs(scores[q].get(i, s) - s) < 1e-12
