import random
import re

import numpy as np
import pyarrow as pa

from gaugeflow.llm import onehash, registry
from gaugeflow.llm.rolling import mix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if len(words) == 1 else zip(words, words[1:]))


def brute(rows):
    """rows: (doc_id, text). Sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return sorted(((i, len(s), low.get(root(k)), i == low.get(root(k)))
                   for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id BIGINT, text STRING, n STRING, kept INT")
    result = onehash.near_duplicates(docs.repartition(3)).collect()
    assert sorted(map(tuple, result), key=repr) == brute(rows)


def test_signature_agrees_as_often_as_sets_are_similar():
    """Also for sets far smaller than the number of bins, where most bins are copied ones."""
    for size, shared in ((5, 4), (50, 40), (2_000, 1_600), (10, 0)):
        a, b, pairs = [], [], 200
        for k in range(pairs):
            ids = np.arange(size * 2, dtype=np.uint64) + np.uint64(k * 100_000)
            a.append(ids[:size])
            b.append(ids[:shared] if shared else ids[size:])
        sig = []
        for sets in (a, b):
            rows = np.repeat(np.arange(pairs), [len(s) for s in sets])
            hashes = mix(np.concatenate(sets))
            order = np.lexsort((hashes, rows))
            sig.append(onehash.one_permutation(rows, hashes[order], pairs, 160))
        wanted = shared / size
        assert abs((sig[0] == sig[1]).mean() - wanted) < 0.02
    assert not onehash.one_permutation(np.zeros(0, np.int64), np.zeros(0, np.uint64), 2, 160).any()


def families(draw, count, members, changes):
    """Copies of random texts with a few words changed each, so that similarities lie around the threshold."""
    rows, names = [], 0
    for _ in range(count):
        base = [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randrange(60)) for _ in range(draw.choice((6, 40, 120)))]
        for _ in range(members):
            text = list(base)
            for _ in range(draw.randrange(int(changes * len(base)) + 1)):
                text[draw.randrange(len(text))] = f"new{draw.randrange(30)}"
            rows.append((names, " ".join(text).title() if names % 3 == 0 else " ".join(text)))
            names += 1
    draw.shuffle(rows)
    return rows


def test_families_near_the_threshold(spark, monkeypatch):
    check(spark, families(random.Random(6), 30, 8, 0.12))
    # Blocks of a few classes: every pair of blocks is a group of its own.
    monkeypatch.setattr(onehash, "BLOCK", 7)
    monkeypatch.setattr(onehash, "BLOCK_BYTES", 4_000)
    check(spark, families(random.Random(7), 5, 60, 0.14))


def test_chain_through_centres(spark):
    """Neighbours in a chain are linked; its ends have nothing in common."""
    words = [f"w{k}" for k in range(400)]
    check(spark, [(500 - k, " ".join(words[k:k + 60])) for k in range(0, 300, 5)])


def test_open_buckets_are_settled_whole(spark, monkeypatch):
    """Few rows for each band put unlike texts into one bucket, whose centre is linked with few of them."""
    rows = families(random.Random(8), 40, 5, 0.1)
    rows = [(i, "the same opening words of all texts here and there and everywhere " + t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    monkeypatch.setattr(onehash, "BLOCK", 16)
    result = onehash.near_duplicates(docs, bands=64, rows=1).collect()
    assert sorted(map(tuple, result), key=repr) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{k % 9_973}" for k in range(150_000))
    check(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo"), (8, "two one"),
                  (9, long), (10, long + " end"), (None, "one"), (None, None), (None, "alone here"), (6, "one two"), (6, "other text"),
                  (11, "É x"), (12, "é x"), (13, "a a a a"), (14, "a a")])
    check(spark, [(3, "same text here")] * 50 + [(2, "same text here")])
    check(spark, [])


def test_task_emits_a_forest(spark):
    """A block of mutually linked classes leaves one edge less than it has classes."""
    count, bins = 40, 160
    sets = [np.sort(mix(np.concatenate([np.arange(300), [1_000 + k]]).astype(np.uint64))) for k in range(count)]
    sig = onehash.one_permutation(np.repeat(np.arange(count), 301), np.concatenate(sets), count, bins)
    zero = pa.array(np.zeros(count, np.int32))
    table = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(count, np.int64)), zero, zero, zero, pa.array(np.arange(count)), pa.array(np.full(count, 301)),
         pa.array(np.arange(count)), pa.array([c.tobytes() for c in (sig & 0xFF).astype(np.uint8)], pa.binary()),
         pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
        ["component_group", "i", "j", "own", "node", "n", "component", "code", "shingles"])
    edges = list(onehash._verified(80, bins)(iter([table])))
    assert sum(e.num_rows for e in edges) == count - 1


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    result = registry.QUERIES["op12_minhash_dedup"](spark, sf).collect()
    assert sorted(map(tuple, result), key=repr) == brute(rows)
