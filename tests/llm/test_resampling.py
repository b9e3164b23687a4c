import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from gaugeflow.llm import registry, resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALPHABET = "abcXYZ09 ,.-éüß漢字\x00\x7f@[`{/:"


def features(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10_000
                        for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(rows, target):
    """rows: (doc_id, text). Sorted (doc_id, n_features, weight, score, rank)."""
    found = [(i, *features(t)) for i, t in rows]
    raw, wanted = (Counter(b for bs in side for b in bs)
                   for side in ([f for *_, f in found], [features(t)[1] for t in target]))
    total, goal = raw.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (total + 10_000) / ((raw[b] + 1) * (goal + 10_000))))
            for b in raw}
    out = []
    for i, words, own in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[3]))
    for rank, row in enumerate(able[:5 * len(able) // 100], 1):
        row[5] = rank
    return sorted((tuple(r[:1] + r[2:]) for r in out), key=repr)


def check(spark, rows, target):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id BIGINT, text STRING, score INT, rank STRING")
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id INT, text STRING")
    result = resampling.importance_sample(docs.repartition(3), wanted).drop("n_words").collect()
    assert sorted(map(tuple, result), key=repr) == brute(rows, target)


def test_crc_of_any_span(monkeypatch):
    draw = random.Random(3)
    texts = [None, "", "one", "A b", "x" * 5_000 + " y " + "Zq" * 300 + " w", "é" * 77] + [
        "".join(draw.choice(ALPHABET) for _ in range(draw.randrange(200))) for _ in range(150)]
    # Short tables and slabs send spans through blocks and over slab borders.
    for reach, slab in ((8, 100), (16, 64), (128, 1 << 20)):
        monkeypatch.setattr(resampling, "SLAB", slab)
        got = [[] for _ in texts]
        for bucket, row in resampling.hashed_runs(pa.array(texts), resampling.PositionCrc(reach), 10_000, 3)[1]:
            for b, r in zip(bucket.tolist(), row.tolist()):
                got[r].append(b)
        assert [sorted(g) for g in got] == [sorted(features(t)[1]) for t in texts]


def test_very_long_word_and_text():
    texts = ["0123456789abcdef" * 200_000 + " end", "word " * 400_000]
    crc, got = resampling.PositionCrc(), [Counter(), Counter()]
    for bucket, row in resampling.hashed_runs(pa.array(texts), crc, 10_000, 3)[1]:
        for r in (0, 1):
            got[r].update(bucket[row == r].tolist())
    assert got == [Counter(features(t)[1]) for t in texts]


def test_ranks_ties_nulls_and_repeats(spark):
    draw = random.Random(4)
    rows = [(k // 2 if k < 40 else k, " ".join(draw.choice("abcdef") for _ in range(draw.randrange(15, 40)))) for k in range(300)]
    rows += [(None, "a b " * 12), (None, None), (7, ""), (8, None), (9, "a " * 30), (9, "a " * 30)]
    check(spark, rows, ["a b c", "f e d", None, ""])
    check(spark, [(5, "q r s t " * 6)] * 120, ["q r"])


def test_empty_tables(spark):
    check(spark, [], ["a"])
    check(spark, [(1, "a b"), (2, None)], [])


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    result = registry.QUERIES["op11_importance_resampling"](spark, sf)
    assert result.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in result.dtypes} == {"bigint"}
    assert sorted(map(tuple, result.collect()), key=repr) == brute(rows, target)
