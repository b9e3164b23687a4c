import random

import pytest

from gaugeflow.llm import graph, jaccard, registry


def shingles(text, size):
    words = (text or "").split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, similarity=0.8, size=5):
    """Sorted (doc_id, class_id, n_links, class_size)."""
    sets = [shingles(t, size) for _, t in rows]
    near = [set() for _ in rows]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for other in {o for x in s for o in holders[x] if o > k}:
            both = len(s & sets[other])
            if both / (len(s) + len(sets[other]) - both) >= similarity - 1e-12:
                near[k].add(other)
                near[other].add(k)
    label = list(range(len(rows)))
    for k in range(len(rows)):
        stack, seen = [k], {k}
        while stack:
            for o in near[stack.pop()] - seen:
                seen.add(o)
                stack.append(o)
        label[k] = seen
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[o][0] for o in label[k] if rows[o][0] is not None]
        out.append((i, min(ids) if ids else None, len(near[k]), len(label[k])))
    return sorted(out, key=repr)


def joined(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id BIGINT, text STRING, node INT")
    result = jaccard.similar_groups(docs.repartition(3), **more)
    return sorted((tuple(r) for r in result.collect()), key=repr), docs


def near_texts(seed=2, bases=6, each=12):
    draw = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(60, 200))]
        for _ in range(each):
            words = list(base)
            for _ in range(draw.randrange(5)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [512, 5])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_texts()
    assert joined(spark, rows)[0] == brute(rows)


def test_pairs_at_the_threshold_shorten_the_prefix(spark, monkeypatch):
    used = []
    paths = jaccard._paths
    monkeypatch.setattr(jaccard, "_paths", lambda trees, depth, length: used.append(length) or paths(trees, depth, length))
    # 36 shared shingles and 4 or 5 of their own: similarity 0.80 exactly.
    rows = []
    for k in range(2000):
        words = [f"w{k}_{i}" for i in range(40)]
        rows += [(2 * k, " ".join(words + [f"a{i}" for i in range(4)])), (2 * k + 1, " ".join(words + [f"b{i}" for i in range(5)]))]
    found, _ = joined(spark, rows)
    assert used and 1 - (1 - 0.8 ** used[-1]) ** jaccard.TREES >= jaccard.TARGET_RECALL
    assert sum(r[2] == 1 for r in found) >= 2 * 2000 * 0.999 - 4
    assert jaccard.prefix_length(0.8) == 7 and jaccard.prefix_length(0.95) == 8 and jaccard.prefix_length(0.5) == jaccard.SHORTEST


def test_large_groups(spark):
    rows = near_texts(seed=3, bases=1, each=150)
    assert joined(spark, rows)[0] == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "a  b"), (6, "a c"), (7, long), (8, long + " end"),
            (None, "a b"), (9, "q r s t u v"), (9, "q r s t u v"), (9, "other words are in this one"), (None, None)]
    found, docs = joined(spark, rows)
    assert found == brute(rows)
    kept = jaccard.without_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(((r[0], (r[1] or "")[:30]) for r in kept.collect()), key=repr) == sorted([
        (1, ""), (2, ""), (3, " \t"), (4, "a b"), (6, "a c"), (7, long[:30]), (9, "q r s t u v"),
        (9, "other words are in this one"), (None, "")], key=repr)
    assert joined(spark, [])[0] == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201)], "a BIGINT, b BIGINT")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(71)}, 200: 200, 201: 200}


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    result = registry.QUERIES["op10_jaccard_join"](spark, sf).collect()
    assert sorted((tuple(r) for r in result), key=repr) == brute(rows)
