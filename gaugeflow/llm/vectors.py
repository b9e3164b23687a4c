"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph; the graph is cut into balanced parts with few
edges between them, and a softmax classifier learns the part of a vector. Every vector of the table is
stored under its most probable part. A query looks into its most probable parts, as many as the sample
needs to reach the target recall, and the vectors there are ranked by their exact cosine.

Spark assigns, groups and ranks: a part of any size is cut into blocks, so that one common vector or a
large part never meets in one task, and each block answers for each query with its nearest few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import bounds, gathered, stored

# Vectors in the sample that parts and classifier are fitted on (about this many, never more).
SAMPLE = 8_000
# Parts, and neighbours of a vector in the graph.
PARTS = 32
GRAPH = 10
# Target recall, measured on the sample.
RECALL = 0.98
# Vectors of a part that one task compares with the queries of the part.
BLOCK = 4_096
# Queries compared at once.
QUERIES = 2_048
EPOCHS = 60


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, count: int) -> np.ndarray:
    """Indices of the ``count`` rows of largest cosine to each row, itself left out, block by block."""
    out = np.empty((len(x), count), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        top = np.argpartition(-s, count - 1, axis=1)[:, :count]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[a:a + 1024] = np.take_along_axis(top, order, 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5, slack: float = 1.1,
                   rounds: int = 20) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the neighbour graph.

    Starts from balanced clusters, then moves vectors, most gain first, to the part that holds most of
    their neighbours while that part has room.
    """
    draw = np.random.default_rng(seed)
    n = len(x)
    room = max(1, int(np.ceil(n / parts * slack)))
    centres = x[draw.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        near = x @ centres.T
        part = np.full(n, -1)
        size = np.zeros(parts, np.int64)
        wish = np.argsort(-near, axis=1)
        for k in range(parts):
            open_ = np.flatnonzero(part < 0)
            open_ = open_[np.argsort(-near[open_, wish[open_, k]], kind="stable")]
            target = wish[open_, k]
            order = np.argsort(target, kind="stable")
            first = np.searchsorted(target[order], target[order])
            take = order[np.arange(len(order)) - first < (room - size)[target[order]]]
            part[open_[take]] = target[take]
            size = np.bincount(part[part >= 0], minlength=parts)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    source = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    target = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(source * parts + part[target], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        # Half of the movers at a time, so that neighbours do not swap places for ever.
        for v in np.argsort(-gain, kind="stable")[:max(1, (gain > 0).sum() // 2)].tolist():
            if gain[v] > 0 and size[best[v]] < room:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Softmax over the parts, from one hidden layer on unit vectors."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, seed: int = 6, hidden: int = 128):
        draw = np.random.default_rng(seed)
        d = x.shape[1]
        self.w = [draw.standard_normal((d, hidden)) * np.sqrt(2 / d) * 2, np.zeros(hidden),
                  draw.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.w]
        step, total = 0, EPOCHS * max(1, -(-len(x) // 256))
        for _ in range(EPOCHS):
            order = draw.permutation(len(x))
            for a in range(0, len(x), 256):
                i = order[a:a + 256]
                step += 1
                h, p = self._forward(x[i])
                p[np.arange(len(i)), part[i]] -= 1
                p /= len(i)
                back = (p @ self.w[2].T) * (h > 0)
                grads = [x[i].T @ back, back.sum(0), h.T @ p, p.sum(0)]
                rate = 0.003 * (1 - step / (total + 1))
                for k, g in enumerate(grads):
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def _forward(self, x):
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True)

    def parts(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` most probable parts of each vector, most probable first."""
        return np.argsort(-self._forward(x)[1], axis=1, kind="stable")[:, :count]


class Index:
    """What a fit returns: the vectors' length, the router, and the number of parts a query visits."""

    def __init__(self, length: int, router: Router | None, probes: int):
        self.length, self.router, self.probes = length, router, probes


def fit_index(sample: np.ndarray, k: int, parts: int = PARTS, target: float = RECALL) -> Index:
    """Fit on unit vectors. Probes: the fewest parts that hold the target share of the sample's true
    neighbours, with a part that the sample needs more for safety."""
    n, length = sample.shape
    parts = min(parts, n // 64)
    if parts < 2:
        return Index(length, None, 1)
    graph = nearest(sample, min(GRAPH, n - 1))
    part = balanced_parts(sample, graph, parts)
    # A fifth of the sample is not learned from, and tells how many parts a query must visit.
    test = np.arange(n) % 5 == 0
    router = Router(sample[~test], part[~test], parts)
    home = router.parts(sample, 1)[:, 0]
    order = router.parts(sample[test], parts)
    held = np.argsort(order, axis=1)[np.arange(len(order))[:, None], home[graph[test][:, :k]]]
    reached = (held[:, :, None] < np.arange(1, parts + 1)).mean(axis=(0, 1))
    probes = min(parts, int(np.argmax(reached >= target)) + 2)
    return Index(length, router, probes)


def _matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def _routed(index: Index, count: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _unit(_matrix(part.column("vector"), index.length))
                found = np.zeros((len(x), 1), np.int64) if index.router is None else index.router.parts(x, count)
                size = pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("vector"),
                     pa.ListArray.from_arrays(size, pa.array(found.ravel().astype(np.int32)))],
                    ["vec_id", "vector", "parts"])

    return run


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` with the same row of ``x``, in double precision; equal vectors give
    equal results wherever they stand."""
    dot = np.einsum("ij,ij->i", q, x)
    return dot / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x)))


def _ranked(k: int, length: int):
    """Nearest ``k`` vectors of a block for each of its queries."""

    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        ids, asks = table.column("vec_id").to_numpy(), table.column("is_query").to_numpy()
        raw = _matrix(table.column("vector"), length)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in bounds(first):
            ask, held = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
            held = held[np.argsort(ids[held], kind="stable")]
            if not len(ask) or not len(held):
                continue
            unit = _unit(raw[held])
            for c in range(0, len(ask), 256):
                rows = ask[c:c + 256]
                s = _unit(raw[rows]) @ unit.T
                s[ids[rows][:, None] == ids[held][None, :]] = -np.inf
                keep = min(k, len(held))
                worst = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                # All that might tie with the last after rounding; they are measured again, one way for all.
                i, j = np.nonzero((s >= worst[:, None] - 1e-9) & (s > -np.inf))
                score = np.concatenate([cosines(raw[rows[i[p:p + 65536]]], raw[held[j[p:p + 65536]]])
                                        for p in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                order = np.lexsort((ids[held[j]], -score, i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                top = place < k
                out.append((ids[rows[i[top]]], ids[held[j[top]]], score[top]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    return gathered(compute, ("part", "block", "ask"), 8 << 20)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the vectors that can be compared: not null, no null or non-finite component, not zero."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    named = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return named.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(fine & some)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int = PARTS, sample: int = SAMPLE,
           target: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each query, by cosine.

    ``vectors`` and ``queries`` have vec_id and vector, as :func:`usable` gives them; a query's own vec_id
    is no candidate for it. Ties go to the smaller vec_id. Vectors whose length is not the commonest one
    (the smaller of two) take no part. Repeated rows of ``vectors`` are candidates each; repeated queries
    are answered once. Fewer candidates give fewer rows; empty tables give none.
    """
    vectors, seen = stored(vectors.withColumn("length", F.size("vector")), "vectors")
    lengths = vectors.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    length = lengths["length"]
    right = vectors.where(F.col("length") == length).select("vec_id", "vector")
    asked = queries.where(F.size("vector") == length).dropDuplicates(["vec_id"])
    order = F.xxhash64(F.lit("sample"), "vec_id", "vector")
    cut = int((1 << 30) * min(1.0, 0.9 * sample / seen["rows"]))
    rows = right.where(F.pmod(order, F.lit(1 << 30)) < cut).orderBy(order, "vec_id").limit(sample).toArrow()
    index = fit_index(_unit(_matrix(rows.column("vector"), length)) if rows.num_rows else np.zeros((0, length)),
                      k, parts, target)
    shape = "vec_id BIGINT, vector ARRAY<DOUBLE>, parts ARRAY<INT>"
    # Parts are cut into blocks by counted sizes; every block of a part gets all the part's queries.
    housed, _ = stored(right.mapInArrow(_routed(index, 1), shape).select(
        "vec_id", "vector", F.col("parts")[0].alias("part")), "housed")
    sizes = housed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # A row per part, and the parts are a parameter: this is small.
    sizes = F.broadcast(sizes)
    held = housed.join(sizes, "part").select(
        "part", F.pmod(F.xxhash64("vec_id", "vector"), "blocks").cast("int").alias("block"),
        F.lit(False).alias("is_query"), "vec_id", "vector", F.lit(None).cast("int").alias("ask"))
    sought = asked.mapInArrow(_routed(index, index.probes), shape).select(
        "vec_id", "vector", F.explode("parts").alias("part")).join(sizes, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_query"),
        "vec_id", "vector", F.lit(None).cast("int").alias("ask"))
    groups = sought.groupBy("part").agg(F.ceil(F.count_distinct("vec_id") / QUERIES).cast("int").alias("asks"))
    groups = F.broadcast(groups)
    # Many queries of one part are dealt over several groups, each with the block's vectors.
    held = held.join(groups, "part").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("asks")
    sought = sought.join(groups, "part").withColumn("ask", F.pmod(F.xxhash64("vec_id"), "asks").cast("int")).drop("asks")
    near = (
        held.unionByName(sought).repartition("part", "block", "ask").sortWithinPartitions("part", "block", "ask")
        .mapInArrow(_ranked(k, length), "query_id BIGINT, vec_id BIGINT, score DOUBLE"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
