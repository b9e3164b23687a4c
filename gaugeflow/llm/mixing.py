"""Mixing sources to target weights by entropy balancing.

The mix gives document i the rate r_i >= 0 that is closest to 1 in relative entropy, subject to
sum(r_i * size_i) = target for every source and r_i <= ``CAP``. The dual is convex with one multiplier
per source: r_i = min(CAP, exp(multiplier * size_i / mean size)). Newton iterations on all sources at
once solve it; each iteration is one aggregation over (source, size, count), which Spark keeps small by
summing equal sizes first. Rates are then rounded into whole copies by a hash of the document, and a few
further aggregations shift the rounding of each source so that its taken words meet its target. Equal rows
are one group with a number; the group is rounded as a whole and its copies are then dealt to its rows.

Everything is DataFrame functions. Sums that decide the result are exact decimals, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import WORD, pick, small, stored

# Largest number of copies of a document, and largest target as a multiple of a source.
CAP = 3
# Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
ITERATIONS = 40
TOLERANCE = 1e-6
# The multipliers lie between minus and plus this.
BRACKET = 4096.0
# Grid points and rounds of the search for each source's rounding shift.
GRID = 16
ROUNDS = 5
# Rows of a group of equal rows that one task writes in a run; larger groups are dealt over many tasks.
BLOCK = 4096

_EXACT = "decimal(38,9)"


def text_size(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``target`` to a table (source, source_size) of one row per source.

    Sources in code-point order, null last, have the weights in turn and share all words. A target stops
    at ``cap`` times its source; the excess is shared anew by weight until none is above. That is
    min(cap * size, weight * level) with one level for all: in the order of cap * size / weight, the
    level follows from the sums before and after. The table has a row per source, so one task may hold it.
    """
    # Windows without a key: a row per source only.
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    limit = F.col("source_size") * cap
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((limit / F.col("weight")).cast("double"), "weight", "source_size")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighted.withColumn("level", level.cast("double"))
    fits = F.col("level") * F.col("weight") <= limit
    shared = levels.withColumn("shared", F.max(F.when(fits, F.col("level"))).over(whole))
    return shared.select("source", "source_size", F.least(
        limit.cast("double"), F.coalesce(F.col("shared") * F.col("weight"), limit.cast("double"))).alias("target"))


def _rate(multiplier: Column, scaled: Column, cap: int) -> Column:
    return F.when(multiplier * scaled >= F.log(F.lit(float(cap))), F.lit(float(cap))).otherwise(
        F.exp(F.greatest(multiplier * scaled, F.lit(-60.0))))


def balance(counts: DataFrame, targets: DataFrame, cap: int = CAP, iterations: int = ITERATIONS) -> DataFrame:
    """Add the dual ``multiplier`` to ``targets``; ``counts`` has (source, size, n).

    Newton steps, of limited reach, inside a bracket that shrinks from both sides (a step
    that leaves it halves it), so that the iteration converges also where the cap makes the slope flat.
    """
    n = F.col("n")
    sums = counts.groupBy("source").agg(F.greatest((F.sum(n * F.col("size")) / F.sum(n)).cast("double"), F.lit(1.0)).alias("mean"))
    state, seen = stored(
        targets.join(sums, targets["source"].eqNullSafe(sums["source"]), "left").select(
            targets["source"], "source_size", "target", "mean", F.lit(0.0).alias("multiplier"),
            F.lit(-BRACKET).alias("low"), F.lit(BRACKET).alias("high"), F.lit(False).alias("done")), "dual")
    for _ in range(iterations):
        scaled = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), scaled, cap)
        inner = F.when(rate < cap, rate * scaled * F.col("size")).otherwise(0.0)
        table = small(state, seen["rows"]).alias("s")
        sides = counts.alias("c").join(table, F.expr("c.source <=> s.source"))
        step = sides.select("c.source", (rate * F.col("size") * n).cast(_EXACT).alias("v"),
                            (inner * n).cast(_EXACT).alias("g")).groupBy("source").agg(
            F.sum("v").cast("double").alias("value"), F.sum("g").cast("double").alias("slope"))
        new = small(state, seen["rows"]).alias("s").join(step.alias("t"), F.expr("s.source <=> t.source"), "left")
        miss = F.coalesce(F.col("t.value"), F.lit(0.0)) - F.col("s.target")
        low = F.when(miss < 0, F.col("s.multiplier")).otherwise(F.col("s.low"))
        high = F.when(miss > 0, F.col("s.multiplier")).otherwise(F.col("s.high"))
        reach = 1 + F.abs("s.multiplier")
        newton = F.col("s.multiplier") - F.greatest(-reach, F.least(reach, F.try_divide(miss, F.col("t.slope"))))
        inside = F.col("t.slope").isNotNull() & (F.col("t.slope") > 0) & (newton > low) & (newton < high)
        near = F.abs(miss) <= TOLERANCE * F.col("s.target")
        # Targets at the cap are met by any large multiplier.
        full = F.col("s.target") >= cap * F.col("s.source_size")
        done = F.col("s.done") | near | full
        moved = F.when(full, F.lit(1e300)).when(done, F.col("s.multiplier")).when(inside, newton).otherwise((low + high) / 2)
        state, seen = stored(new.select(
            "s.source", "s.source_size", "s.target", "s.mean", moved.alias("multiplier"), low.alias("low"),
            high.alias("high"), done.alias("done")), "dual", open=F.count(F.when(~F.col("done"), 1)))
        if not seen["open"]:
            break
    return state.select("source", "source_size", "target", "mean", "multiplier")


def _copies(shift: Column, cap: int) -> Column:
    """Copies of all ``m`` equal rows of a group together.

    If row j of them were rounded with the random number (j + u) / m, the sum of the rounded rates would be
    just this, and no row would be above ``cap`` or below 0.
    """
    m = F.col("m")
    return F.greatest(F.lit(0), F.least(cap * m, F.floor(m * (F.col("rate") + shift) + F.col("u")))).cast("bigint")


def _each_row(groups: DataFrame) -> DataFrame:
    """Every row of the groups, with its ``place`` from 0 in its group."""
    few = groups.where(F.col("m") <= BLOCK).withColumn("place", F.explode(F.expr("sequence(0L, m - 1)")))
    blocks = groups.where(F.col("m") > BLOCK).withColumn(
        "block", F.explode(F.expr(f"sequence(0L, (m - 1) div {BLOCK})")))
    many = blocks.repartition("doc_id", "u", "block").withColumn("place", F.explode(
        F.expr(f"sequence(block * {BLOCK}, least(m, (block + 1) * {BLOCK}) - 1)"))).drop("block")
    return few.unionByName(many)


def _rounding(rated: DataFrame, dual: DataFrame, rows: int, cap: int) -> DataFrame:
    """(source, shift): the shift of the rounding that brings a source's taken words nearest its target.

    Taken words grow with the shift, so each round looks at a grid inside the last bracket.
    """
    state, seen = stored(dual.select(
        "source", "target", F.lit(-1.0).alias("low"), F.lit(2.0 / GRID).alias("width")), "shifts")
    for _ in range(ROUNDS):
        sides = rated.alias("r").join(small(state, rows).alias("s"), F.expr("r.source <=> s.source"))
        taken = sides.groupBy("r.source").agg(*[
            F.sum(F.col("size") * _copies(F.col("low") + F.col("width") * k, cap)).alias(f"t{k}")
            for k in range(GRID + 1)])
        both = small(state, rows).alias("s").join(taken.alias("t"), F.expr("s.source <=> t.source"))
        best = F.lit(0)
        for k in range(1, GRID):
            best = F.when(F.col(f"t{k}") <= F.col("target"), F.lit(k)).otherwise(best)
        cell = both.withColumn("k", best).withColumn("from", F.col("low") + F.col("width") * F.col("k"))
        taken_at = F.array(*[F.col(f"t{k}") for k in range(GRID + 1)])
        under = F.element_at(taken_at, F.col("k") + 1)
        over = F.element_at(taken_at, F.col("k") + 2)
        nearer = F.when(F.col("target") - under <= over - F.col("target"), F.col("from")).otherwise(
            F.col("from") + F.col("width"))
        state, seen = stored(cell.select(
            "s.source", "target", F.col("from").alias("low"), (F.col("width") / GRID).alias("width"),
            nearer.alias("shift")), "shifts")
    return state.select("source", "shift")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken for every row of ``docs``.

    ``docs`` has doc_id, text and source. Size is the number of words (null and empty texts: 0). Sources
    share all words by :func:`source_targets`. ``copies`` (0 to ``cap``) is the rate rounded by a hash of
    doc_id and text, taken = copies * size. Equal rows share the copies of their group, which differ by one
    at most; which of them gets more is not told apart. A null source is a source. Documents
    of size 0 take nothing. Other columns are ignored; an empty table gives an empty result.
    """
    sized = pick(docs, "doc_id", "text", "source").select(
        "doc_id", "source", text_size().alias("size"),
        ((F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("u"))
    groups, _ = stored(sized.groupBy("doc_id", "source", "size", "u").agg(F.count(F.lit(1)).alias("m")), "sized")
    counts, _ = stored(groups.groupBy("source", "size").agg(F.sum("m").alias("n")), "sizes")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets, seen = stored(source_targets(sources, weights, cap), "targets")
    rows = seen["rows"]
    dual, _ = stored(balance(counts, targets, cap), "multipliers")
    rate = F.when(F.col("size") > 0, F.coalesce(
        _rate(F.col("multiplier"), F.col("size") / F.col("mean"), cap), F.lit(0.0))).otherwise(0.0)
    rated = groups.alias("d").join(small(dual, rows).alias("m"), F.expr("d.source <=> m.source")).select(
        "doc_id", "d.source", "size", "source_size", "target", rate.alias("rate"), "u", F.col("d.m").alias("m"))
    shifts = _rounding(rated, dual, rows, cap)
    dealt = rated.alias("r").join(small(shifts, rows).alias("s"), F.expr("r.source <=> s.source")).select(
        "r.*", F.when(F.col("size") > 0, _copies(F.col("shift"), cap)).otherwise(0).cast("bigint").alias("all"))
    copies = F.expr("all div m + CASE WHEN place < all % m THEN 1 ELSE 0 END")
    return _each_row(dealt).select(
        "doc_id", "source", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("bigint").alias("taken"))
