import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import audit, registry

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    """The filters that each (doc_id, source, text) fails."""
    out = []
    for i, _, text in rows:
        text = text or ""
        words = WORDS.findall(text)
        lower = i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows)
        out.append("".join(f for f, hit in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), lower)) if hit))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    parts, fails, out = sorted({s or "" for _, s, _ in rows}), failed(rows), []
    for part in parts:
        own = [(i, f) for (i, s, _), f in zip(rows, fails) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(removed)
                found.append(["".join(order), step, len(left), len(removed), sum(letter in f for _, f in own) - len(removed),
                              sum(f == letter for _, f in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)])
        out += [(part, *x, shapley[x[0][x[1] - 1]]) for x in found]
    return sorted(out)


def check(spark, rows, labels):
    docs = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id BIGINT, source STRING, text STRING, mask INT")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id BIGINT, quality INT, toxic INT, part STRING")
    result = audit.audit_filters(docs.repartition(3), marks)
    assert sorted(map(tuple, result.collect())) == brute(rows, labels)


def sample(count, seed):
    draw = random.Random(seed)
    texts = [" ".join(draw.choice(("a", "B", "c1", "dd", f"x{draw.randrange(400)}", f"y{draw.randrange(400)}", "é"))
                      for _ in range(draw.choice((3, 150, 230, 300)))) + draw.choice(("", "", " #", "|", "\x0b$")) for _ in range(count)]
    rows = [(k, draw.choice(("s", "t", None, "")), draw.choice(texts)) for k in range(count)]
    return rows, [(k, draw.choice((0, 1, None)), draw.choice((0, 1))) for k in range(0, count, 2)]


def test_random_documents(spark):
    check(spark, *sample(150, 1))


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    rows = [(None, None, None), (None, "s", "a"), (1, "s", None), (2, None, ""), (3, "t", "a"), (3, "t", "a"), (4, "t", "a"),
            (3, "s", "other"), (5, "s", "other"), (6, "u", long), (7, "u", long), (8, "u", "# " + long.upper()),
            (9, "v", "A b " * 300), (10, "v", "𝒜 a b c " * 12 + "D")]
    check(spark, rows, [(3, 1, 0), (3, 0, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1), (2, None, None)])
    check(spark, [(5, "s", "same")] * 60 + [(4, "t", "same")], [(5, 1, 1)])


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [(1, "s", "a")], [])


@pytest.mark.parametrize("most", [2_048, audit.MOST_COUNTERS])
def test_sketch_never_clears_a_repeat(spark, most):
    """With 16 counters for a text few are shuffled; with far too few the results stay."""
    prints = spark.range(6_000).select(F.xxhash64(F.when(F.col("id") < 5_000, F.col("id")).otherwise(F.lit(-1))).alias("print"))
    repeated = audit.possible_repeats(prints, 6_000, most=most)
    seen = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).select("n", repeated("print").alias("hit")).collect()
    assert all(r.hit for r in seen if r.n > 1)
    if most > 6_000:
        assert sum(r.hit for r in seen if r.n == 1) < 100
    rows, labels = sample(80, 2)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    marks = spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    result = audit.order_effects(audit.mask_counts(audit.fail_masks(docs, most=most), marks))
    assert sorted(map(tuple, result.collect())) == brute(rows, labels)


def test_query_equals_brute_force(spark, sf):
    rows, labels = ([tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]
                    for name, columns in (("documents", ("doc_id", "source", "text")), ("labels", ("doc_id", "quality", "toxic"))))
    result = registry.QUERIES["op13_filter_audit"](spark, sf).collect()
    assert sorted(map(tuple, result)) == brute(rows, labels)
