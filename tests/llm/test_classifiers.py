import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gaugeflow.llm import quality, registry, toxicity
from gaugeflow.llm.rolling import Powers
from pyspark.sql import functions as F

BIG = "/root/testdata/sf0.1"
CONTRACT = [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def outcome(spark, name, label, folds, held):
    scored = registry.QUERIES[name](spark, BIG)
    assert scored.dtypes == CONTRACT
    rows = scored.join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    return [(r[label], r.predicted) for r in rows if r.held_out]


def test_quality_on_held_out_rows(spark):
    found = outcome(spark, "op9_quality", "quality", 3, 1)
    assert np.mean([a == b for a, b in found]) > 0.97


def test_prior_needs_no_negatives(spark):
    """Trusted positives alone: the prior is found and held-out rows are told apart without any label 0."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    share = labels.agg(F.avg("label")).first()[0]
    for kept in ("label = 1", "label = 1 AND doc_id % 10 < 4"):
        net, prior = quality.learn(docs, labels.where(kept), quality.remainder("doc_id", 3) != 1)
        assert prior == pytest.approx(share, abs=0.05)
    held = docs.join(labels, "doc_id").where(quality.remainder("doc_id", 3) == 1).mapInArrow(
        quality._scored(net, prior), "doc_id BIGINT, text STRING, label INT, score DOUBLE")
    assert held.where("(score >= 0.5) = (label = 1)").count() / held.count() > 0.97


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_prior_of_mixed_rows(share):
    draw = np.random.default_rng(5)
    good = draw.random(6_000) < share
    x = np.where(good[:, None], 1.0, -1.0) + draw.normal(0, 0.7, (6_000, 5))
    assert quality.class_prior(good & (draw.random(6_000) < 0.3), x.astype(np.float32)) == pytest.approx(share, abs=0.05)


def test_risk_is_corrected_where_it_falls_below_zero():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(1, 0.4, (400, 5)), draw.normal(-1, 0.4, (400, 5))
    mixed = np.concatenate([good[:200], bad[:200]])
    net = quality.fit(good[200:].astype(np.float32), mixed.astype(np.float32), 0.5, epochs=200)
    quality.place_boundary(net, mixed, 0.5)
    assert (net.score(good) > 0.5).mean() > 0.98 and (net.score(bad) < 0.5).mean() > 0.98


ODD = [(1, None), (2, ""), (3, "word " * 60_000), (None, "some words"), (4, "same"), (4, "same")]


@pytest.mark.parametrize("score,label", [
    (quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_edges(spark, score, label):
    schema = "doc_id BIGINT, text STRING, score STRING, label INT"
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], schema)
    names = f"doc_id BIGINT, {label} INT, text STRING"
    for labels in ([], [(1, None, "")], [(i, i % 2, "") for i in range(9)] + [(2, 1, ""), (None, 1, "")]):
        result = score(docs, spark.createDataFrame(labels, names)).collect()
        assert sorted((r.doc_id or 0) for r in result) == sorted((i or 0) for i, _ in ODD)
        assert all(0 <= r.score <= 1 for r in result)
    assert score(docs.limit(0), spark.createDataFrame([], names)).collect() == []


def toy(seed, count, bias):
    """Labelled sentences; a group's name goes with insults ``bias`` of the time."""
    draw = random.Random(seed)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(count):
        toxic = draw.random() < 0.4
        words = [draw.choice(plain) for _ in range(12)]
        if toxic:
            words[3] = draw.choice(["stupid", "idiot", "trash"]) if draw.random() < 0.7 else words[3]
        if draw.random() < (bias if toxic else 0.02):
            words[6] = "muslims"
        elif draw.random() < 0.2:
            words[6] = draw.choice(["christians", "hindus"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_penalty_makes_group_names_neutral(spark):
    rows = toy(4, 1500, 0.6)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id BIGINT, toxic INT")
    known = labels.withColumnRenamed("toxic", "label")
    every = known["doc_id"].isNotNull()
    texts = pa.array(["word1 word2 muslims word3", "word1 word2 christians word3", "word1 word2 word3 word4",
                      "word1 stupid idiot word3"])
    gaps = {}
    for penalty in (0.0, 5.0):
        model, _ = toxicity.learn(docs, known, every, penalty)
        score = model.score(texts, Powers(31))
        gaps[penalty] = abs(score[0] - score[1])
        assert score[3] > 0.5
    assert gaps[0.0] > 0.3 and gaps[5.0] < gaps[0.0] / 3


def test_swaps_keep_the_case():
    assert toxicity.swapped("Women and muslims", 0) == "Men and christians"
    assert toxicity.swapped("nothing here", 0) is None


@pytest.mark.parametrize("row", toxicity.IDENTITY)
def test_every_other_group_is_swapped_in(row):
    for name in row:
        copies = toxicity.counterfactuals(f"the {name} of the town")
        assert len(copies) == len(set(copies))
        assert set(copies) >= {f"the {other} of the town" for other in row if other != name}
        assert f"the {name} of the town" not in copies
    both = toxicity.counterfactuals("Muslims and women")
    assert {c.split()[0] for c in both} == {"Christians", "Jews", "Hindus", "Buddhists", "Atheists"}
    assert {c.split()[2] for c in both} == {"men", "girls", "boys"}
    assert toxicity.counterfactuals("no one at all") == toxicity.counterfactuals("") == []


def test_toxicity_on_held_out_rows(spark):
    found = outcome(spark, "op3_toxicity", "toxic", 5, 0)
    assert np.mean([a == b for a, b in found]) > 0.93
    clean = [p for y, p in found if y == 0]
    assert np.mean(clean) < 0.01
