import math
import random
import re

from pyspark.sql import functions as F

from gaugeflow.llm import mixing, registry

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share, fix what is above the cap, share the rest again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s] + 1e-9}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


def check(rows, result, near=0.02):
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(WORDS.findall(r[1] or ""))
    targets = brute_targets(sizes)
    taken = {s: 0 for s in sizes}
    longest = {s: 0 for s in sizes}
    for r in result:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(near * targets[s], longest[s])
    return targets


def test_targets_and_copies(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * min(2000, int(draw.paretovariate(1.1) * 8))),
             draw.choice(["a"] * 12 + ["b", "c", "é", "Z", None])) for i in range(3000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id BIGINT, text STRING, source STRING, size INT")
    once = mixing.mix_sources(docs.repartition(4)).collect()
    assert len(once) == len(rows)
    check(rows, once)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, once)) == sorted(map(str, again))


def test_multiplier_solves_the_dual(spark):
    counts = spark.createDataFrame([("a", s, n) for s, n in ((10, 50), (40, 20), (300, 4))], "source STRING, size BIGINT, n BIGINT")
    total = 10 * 50 + 40 * 20 + 300 * 4
    for share in (0.2, 0.9, 1.3, 2.5):
        targets = spark.createDataFrame([("a", total, share * total)], "source STRING, source_size BIGINT, target DOUBLE")
        r = mixing.balance(counts, targets).first()
        got = sum(n * s * min(3, math.exp(r.multiplier * s / r["mean"])) for s, n in ((10, 50), (40, 20), (300, 4)))
        assert math.isclose(got, share * total, rel_tol=1e-5)


def test_edges(spark):
    schema = "doc_id BIGINT, text STRING, source STRING"
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", "b"), (3, "x y", "b"), (None, "x " * 50_000, None), (4, " ", "c")]
    result = mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(result) == len(rows)
    check(rows, result)
    assert mixing.mix_sources(spark.createDataFrame([], schema)).collect() == []
    assert [r.taken for r in mixing.mix_sources(spark.createDataFrame([(1, None, "a")], schema)).collect()] == [0]


def test_repeated_rows(spark):
    """Many equal rows, more than a block of them, still meet the target of their source."""
    rows = [(7, "one two three four", "a")] * 1000 + [(8, "x " * 30, "b")] * 10_000 + [
        (100 + i, "w " * (1 + i % 50), "c") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    once = mixing.mix_sources(docs.repartition(5)).collect()
    assert len(once) == len(rows)
    check(rows, once, 0.001)
    for source in "ab":
        copies = {r.copies for r in once if r.source == source}
        assert len(copies) <= 2 and max(copies) - min(copies) <= 1
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, once)) == sorted(map(str, again))


def test_query(spark, sf):
    result = registry.QUERIES["op5_mix"](spark, sf)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    check([tuple(r) for r in rows.collect()], result.collect(), 0.1)
    python = [n for n in result._jdf.queryExecution().toString().split() if "Python" in n or "Arrow" in n]
    assert not python
    assert result.where(F.col("taken").isNull()).count() == 0
