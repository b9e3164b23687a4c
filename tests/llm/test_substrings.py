import hashlib
import random
import re
import urllib.parse

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gaugeflow.llm import registry, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """rows: (doc_id, text) in stored order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        words = WORDS.findall(rows[i][1] or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s:s + length])
            if window in seen:
                gone[s:s + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((rows[i][0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def same(spark, rows, length=4, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id BIGINT, text STRING, n_words STRING")
    result = substrings.remove_repeats(docs.repartition(3), length, **more).select(
        "doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, result), key=repr) == sorted(brute(rows, length), key=repr)


def test_random_texts(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice([" ", "\n", " \t", " "]).join(
        draw.choice("abé") for _ in range(draw.randrange(40)))) for i in range(80)]
    same(spark, rows, bucket_windows=50)


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    same(spark, [(1, None), (2, ""), (3, " \n "), (4, "a b c"), (5, "a b c d"), (6, "a b c d"),
                 (7, long), (8, "x " + long), (9, "a a a a a a a a"), (None, "a b c d e")])
    same(spark, [(1, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "z a b c d e")])
    same(spark, [])


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    result = registry.QUERIES["op8_substring_dedup"](spark, sf).collect()
    assert sorted(map(tuple, result)) == sorted(brute(rows, substrings.WINDOW))


def test_packed_texts_are_read_a_few_at_a_time(spark, monkeypatch):
    """Row groups of packed texts do not grow with the partition."""
    packed, seen = [], substrings.stored
    monkeypatch.setattr(substrings, "stored", lambda df, label, *a, **k: (
        lambda got: packed.append((label, got[0].inputFiles())) or got)(seen(df, label, *a, **k)))
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16_000)), lambda i: F.sha2(F.concat("id", F.lit("-"), i), 256)), " ")
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), words.alias("text"))
    found = substrings.remove_repeats(docs)
    assert found.agg(F.sum("n_words"), F.sum("n_removed")).first() == (640_000, 0)
    groups = [pq.ParquetFile(urllib.parse.urlparse(f).path).metadata for label, files in packed if label == "batches" for f in files]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 35 << 20 and max(sizes) < 24 << 20
