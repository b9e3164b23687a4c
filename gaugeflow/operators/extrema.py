"""Local extrema of smoothed series: plateaus, minimum distance, prominence.

The three rules follow the published definition of peak finding: a peak is a run of equal samples
that is strictly higher than both neighbours and stands at its middle sample (rounded down); among
peaks closer than ``distance`` samples the highest stay; a peak's prominence is its height above
the higher of the two lowest points between it and the next strictly higher sample on each side
(or the end of the series). Minima are the maxima of the negated series.

Frames: a smooth series has one row per time ``us``, with ``ord``, the row's number, and ``pos`` and
``until``, its first and last sample, which differ when several samples share the time. Runs of
equal samples are described on their first row, see :data:`RUN_SCHEMA`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.chunks import CHUNK_ROWS, floor_div, group_changes, over_groups
from gaugeflow.session import lookup_table, materialize, measured

# Fixed values of the analysis.
PROMINENCE = 5.0
DISTANCE = 20

# Zones of the distance rule grow from round to round while none holds more undecided peaks than this.
MAX_OPEN = 1_000_000
GROWTH = 8

UNDECIDED, KEPT, DROPPED = 0, 1, 2
# Looks at all peaks at once before what is left is followed peak by peak.
SWEEPS = 6


# What is known about a run from its own chunk. ``turn`` is 1 or -1 for a maximum or minimum that lies
# inside the chunk, 0 for a run that touches the chunk's border, NULL for all other rows. Samples and
# rows are counted from the chunk's first one.
RUN_SCHEMA = (
    ", ord_in BIGINT, pos_in BIGINT, turn INT, run_until BIGINT, before DOUBLE, after DOUBLE, "
    "mid_in BIGINT, mid_us BIGINT, mid_ord BIGINT, "
    "bin_rows BIGINT, bin_w DOUBLE, bin_x DOUBLE, bin_y DOUBLE, bin_xx DOUBLE, bin_xy DOUBLE"
)

# Rows of a bin. Bins begin with their chunk, and the first row of each holds the bin's moments: sums over
# its samples of 1, x, y, x*x and x*y, with x in hours and y as differences from that first row.
BIN_ROWS = 64
_HOUR_US = 3_600_000_000


def describe_runs(table: pa.Table) -> pa.Table:
    """Add the run columns to smooth rows of whole chunks, sorted by chunk and time."""
    if table.num_rows == 0:
        first = np.zeros(0, dtype=bool)
    else:
        first = group_changes(table, ("series", "chunk"))
    us, n = table.column("us").to_numpy(), table.column("n").to_numpy()
    value = table.column("local_median").to_numpy()
    rows = len(us)
    sample = np.cumsum(n) - n
    group = np.flatnonzero(first)
    origin = group[np.cumsum(first) - 1]
    ord_in = np.arange(rows) - origin
    pos_in = sample - sample[origin]

    fresh = first.copy()
    fresh[1:] |= value[1:] != value[:-1]
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], rows)[: len(begin)] - 1
    closes = np.append(first[1:], True)[:rows]
    border = first[begin] | closes[end]
    before = np.where(first[begin], np.nan, value[begin - 1])
    after = np.where(closes[end], np.nan, value[np.minimum(end + 1, rows - 1)])
    here = value[begin]
    top, low = (here > before) & (here > after), (here < before) & (here < after)
    length = sample[end] + n[end] - sample[begin]
    middle = sample[begin] + (length - 1) // 2
    holder = np.searchsorted(sample, middle, side="right") - 1

    shown = np.zeros(rows, dtype=bool)
    shown[begin] = border | top | low

    def on_first_row(values: np.ndarray, dtype, known=None) -> pa.Array:
        full = np.zeros(rows, dtype=values.dtype)
        full[begin] = values
        hidden = ~shown
        if known is not None:
            hidden[begin] |= ~known
        return pa.array(full, dtype, mask=hidden)

    columns = {
        "ord_in": pa.array(ord_in, pa.int64()), "pos_in": pa.array(pos_in, pa.int64()),
        "turn": on_first_row(np.where(border, 0, np.where(top, 1, -1)).astype(np.int32), pa.int32()),
        "run_until": on_first_row(pos_in[begin] + length - 1, pa.int64()),
        "before": on_first_row(before, pa.float64(), ~first[begin]),
        "after": on_first_row(after, pa.float64(), ~closes[end]),
        "mid_in": on_first_row(middle - sample[begin] + pos_in[begin], pa.int64()),
        "mid_us": on_first_row(us[holder], pa.int64()),
        "mid_ord": on_first_row(ord_in[holder], pa.int64()),
    }
    heads = np.flatnonzero(ord_in % BIN_ROWS == 0)
    bin_ = np.cumsum(ord_in % BIN_ROWS == 0) - 1
    x = (us - us[heads][bin_]) / _HOUR_US if rows else np.zeros(0)
    y = value - value[heads][bin_] if rows else np.zeros(0)

    def on_head(values: np.ndarray, dtype) -> pa.Array:
        full = np.zeros(rows, dtype=values.dtype)
        full[heads] = np.add.reduceat(values, heads) if rows else full
        return pa.array(full, dtype, mask=ord_in % BIN_ROWS != 0)

    columns["bin_rows"] = on_head(np.ones(rows, np.int64), pa.int64())
    for name, values in (("w", n), ("x", n * x), ("y", n * y), ("xx", n * x * x), ("xy", n * x * y)):
        columns[f"bin_{name}"] = on_head(values.astype(float), pa.float64())
    for name, column in columns.items():
        table = table.append_column(name, column)
    return table


def place_chunks(instants: DataFrame, min_rows: int = 0) -> DataFrame:
    """Smooth series from stored chunks: positions along the whole series instead of the chunk.

    Only a table with one row per chunk is summed up and joined back, so rows are not shuffled
    while it can be broadcast. Series with fewer than ``min_rows`` samples are left out.
    """
    sums = instants.groupBy("series", "chunk").agg(
        F.sum("n").alias("samples"), F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy("series")
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lookup_table(sums.select(
        "series", "chunk",
        F.coalesce(F.sum("samples").over(earlier), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ord_before"),
        F.sum("samples").over(whole).alias("total"),
    ).where(F.col("total") >= min_rows).drop("total"), "offsets")
    pos, row = F.col("pos_before"), F.col("ord_before")
    return instants.join(offsets, ["series", "chunk"]).select(
        "series", "chunk", "us", (row + F.col("ord_in")).alias("ord"), (pos + F.col("pos_in")).alias("pos"),
        (pos + F.col("pos_in") + F.col("n") - 1).alias("until"), F.col("local_median").alias("smooth"),
        "turn", (pos + F.col("run_until")).alias("run_until"), "before", "after",
        (pos + F.col("mid_in")).alias("mid"), "mid_us", (row + F.col("mid_ord")).alias("mid_ord"),
        (row + F.col("ord_in") - F.pmod("ord_in", F.lit(BIN_ROWS))).alias("bin"),
        "bin_rows", *[f"bin_{m}" for m in ("w", "x", "y", "xx", "xy")])


def turning_points(smooth: DataFrame) -> DataFrame:
    """Runs of equal samples that are local maxima or minima, and the two end runs of a series.

    Columns: series, pos (first sample), kind ('max', 'min' or 'end'), mid (middle sample), value,
    and the time and row number of the middle sample, us and ord.
    """
    inside = smooth.where(F.col("turn").isin(1, -1)).select(
        "series", "pos", F.when(F.col("turn") == 1, "max").otherwise("min").alias("kind"), "mid",
        F.col("smooth").alias("value"), F.col("mid_us").alias("us"), F.col("mid_ord").alias("ord"))
    return inside.unionByName(_border_points(smooth))


def _border_points(smooth: DataFrame) -> DataFrame:
    """The same for runs that touch a chunk border; there are at most two per chunk.

    A chunk's first run continues the previous chunk's last one if the values are equal. Joined
    runs are judged by what lies before the first and after the last of them.
    """
    in_order = Window.partitionBy("series").orderBy("pos")
    pieces = smooth.where(F.col("turn") == 0).select(
        "series", "chunk", "pos", "run_until", F.col("smooth").alias("value"), "before", "after",
        (F.col("before").isNotNull() | ~F.col("smooth").eqNullSafe(F.lag("smooth").over(in_order)))
        .cast("int").alias("opens"))
    runs = pieces.withColumn("run", F.sum("opens").over(in_order)).groupBy("series", "run").agg(
        F.min("pos").alias("pos"), F.max("run_until").alias("run_until"), F.first("value").alias("value"),
        F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"),
        F.min_by(F.struct("before"), "pos").alias("b"), F.max_by(F.struct("after"), "pos").alias("a"))
    left = F.coalesce("b.before", F.lag("value").over(in_order))
    right = F.coalesce("a.after", F.lead("value").over(in_order))
    value = F.col("value")
    judged = runs.select(
        "series", "pos", F.expr("(pos + run_until) div 2").alias("mid"), "value",
        "first_chunk", "last_chunk",
        F.when(left.isNull() | right.isNull(), "end")
        .when((value > left) & (value > right), "max")
        .when((value < left) & (value < right), "min").alias("kind"))
    points = lookup_table(judged.where(F.col("kind").isNotNull()), "border")
    rows = smooth.select("series", "chunk", F.col("pos").alias("from"), "until", "us", "ord")
    near = rows.join(
        points.withColumn("chunk", F.explode(F.sequence("first_chunk", "last_chunk"))), ["series", "chunk"])
    return near.where(F.col("mid").between(F.col("from"), F.col("until"))).select(
        "series", "pos", "kind", "mid", "value", "us", "ord")


# -- minimum distance ------------------------------------------------------------------------------

def _decide(at: np.ndarray, height: np.ndarray, state: np.ndarray, exposed: np.ndarray,
            distance: int) -> np.ndarray:
    """Settle which peaks stay, as far as the given peaks allow.

    A peak is dropped once a higher one in reach stays, and stays once all higher ones in reach
    are dropped and none can lie outside the view (``exposed``). Of equal heights the later wins.
    """
    state = state.copy()
    reach = 1
    while reach < len(at) and np.any(at[reach:] - at[:-reach] < distance):
        reach += 1
    pairs = []
    for step in range(1, reach):
        near = np.flatnonzero(at[step:] - at[:-step] < distance)
        later_wins = height[near + step] >= height[near]
        pairs.append((np.where(later_wins, near + step, near), np.where(later_wins, near, near + step)))
    if not pairs:
        state[(state == UNDECIDED) & ~exposed] = KEPT
        return state
    high = np.concatenate([p[0] for p in pairs])
    low = np.concatenate([p[1] for p in pairs])
    for _ in range(SWEEPS):
        state[low[(state[high] == KEPT) & (state[low] == UNDECIDED)]] = DROPPED
        waiting = exposed.copy()
        waiting[low[state[high] != DROPPED]] = True
        stays = (state == UNDECIDED) & ~waiting
        if not stays.any():
            return state
        state[stays] = KEPT
    return _follow(high, low, height, state, exposed)


def _follow(high: np.ndarray, low: np.ndarray, height: np.ndarray, state: np.ndarray, exposed: np.ndarray) -> np.ndarray:
    """Settle chains, where each peak waits for the next: the undecided peaks once each, highest first."""
    asks = state[low] == UNDECIDED
    order = np.argsort(low[asks], kind="stable")
    higher = high[asks][order].tolist()
    open_ = np.flatnonzero(state == UNDECIDED)
    begin, end = (np.searchsorted(low[asks][order], open_, side).tolist() for side in ("left", "right"))
    turn = np.lexsort((open_, height[open_]))[::-1].tolist()
    peak, now, outside = open_.tolist(), state.tolist(), exposed.tolist()
    for k in turn:
        seen = [now[h] for h in higher[begin[k]:end[k]]]
        if KEPT in seen:
            now[peak[k]] = DROPPED
        elif not outside[peak[k]] and UNDECIDED not in seen:
            now[peak[k]] = KEPT
    return np.array(now, dtype=state.dtype)


def _distance_round(distance: int, rows: int, halo: int):
    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        mid = table.column("mid").to_numpy()
        zone = table.column("zone").to_numpy()
        at = mid - zone * rows + halo
        exposed = (at - distance < 0) & (zone > 0) | (at + distance >= rows + 2 * halo)
        key = (np.cumsum(first) - 1) * (rows + 4 * (halo + distance)) + at
        state = _decide(key, table.column("height").to_numpy(), table.column("state").to_numpy(),
                        exposed, distance)
        core = np.flatnonzero(table.column("core").to_numpy(zero_copy_only=False)
                              & (table.column("state").to_numpy() == UNDECIDED))
        kept = table.select(["series", "kind", "mid", "height", "us", "ord"]).take(pa.array(core))
        return kept.append_column("state", pa.array(state[core], pa.int64()))

    return over_groups(compute, ("series", "kind", "zone"))


def min_distance(peaks: DataFrame, distance: int = DISTANCE, rows: int = CHUNK_ROWS,
                 halo: int | None = None) -> DataFrame:
    """The peaks that stay when of any two closer than ``distance`` the higher is preferred.

    ``peaks`` has series, kind, mid and height, and us and ord to pass on. Each zone of ``rows``
    samples is settled with a halo of neighbouring peaks, and a decision is taken only if nothing
    outside the view could change it. What stays open, in long chains of rising peaks, goes to another
    round with the peaks that stay nearby, in larger zones as long as these hold few open peaks. So
    chains of any length are exact, a settled peak is written once, and no task holds a whole series.
    """
    halo = 50 * distance if halo is None else halo
    if not distance <= halo <= rows:
        raise ValueError("need distance <= halo <= rows")
    key = ["series", "kind", "zone"]
    columns = ["series", "kind", "mid", "height", "us", "ord", "state"]
    current = peaks.select(*columns[:-1], F.lit(UNDECIDED).cast("bigint").alias("state"))
    kept = None
    while True:
        def zone(shift: int):
            return floor_div(F.col("mid") + shift, rows)

        spread = (
            current.withColumn("zone", F.explode(F.array_distinct(F.array(zone(-halo), zone(0), zone(halo)))))
            .where("zone >= 0")
            .select(*columns, "zone", (F.col("zone") == zone(0)).alias("core"))
        )
        # Only peaks that were undecided come back.
        settled, seen = measured(
            spread.repartition(*key).sortWithinPartitions("zone", "series", "kind", "mid")
            .mapInArrow(
                _distance_round(distance, rows, halo),
                "series STRING, kind STRING, mid BIGINT, height DOUBLE, us BIGINT, ord BIGINT, state BIGINT"),
            "distance", undecided=F.count(F.when(F.col("state") == UNDECIDED, 1)))
        stays = settled.where(F.col("state") == KEPT)
        kept = stays if kept is None else kept.unionByName(stays)
        if not seen["undecided"]:
            return kept.drop("state")
        still = settled.where(F.col("state") == UNDECIDED)
        cell = floor_div(F.col("mid"), distance)
        cells = lookup_table(
            still.select("series", "kind", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct(), "cells")
        near = kept.withColumn("cell", cell).join(cells, ["series", "kind", "cell"], "left_semi")
        current = still.unionByName(near.select(*columns))
        most = still.groupBy("series", "kind", zone(0)).count().agg(F.max("count")).first()[0]
        if most * GROWTH <= MAX_OPEN:
            rows *= GROWTH


# -- prominence ------------------------------------------------------------------------------------

def _look_left(height: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the minimum back to the last strictly higher one of its group, and whether
    there was none.

    Every sample points to the one before what it has seen, and jumps on over what that one has
    seen while it is not higher; all samples jump at once.
    """
    low = height.copy()
    back = np.arange(len(height)) - 1
    back[starts] = -1
    moving = np.flatnonzero(back >= 0)
    while len(moving):
        onto = back[moving]
        passes = height[onto] <= height[moving]
        moving, onto = moving[passes], onto[passes]
        low[moving], back[moving] = np.minimum(low[moving], low[onto]), back[onto]
        moving = moving[back[moving] >= 0]
    return low, back < 0


def _records(height: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples strictly higher than all earlier ones of their group."""
    rank = np.unique(height, return_inverse=True)[1]
    # Every group's ranks lie above those of the groups before it.
    key = rank + (np.cumsum(starts) - 1) * (len(height) + 1)
    record = np.ones(len(height), dtype=bool)
    record[1:] = key[1:] > np.maximum.accumulate(key)[:-1]
    return record


def _scan_groups(table: pa.Table, first: np.ndarray) -> pa.Table:
    """Valley floors of the queried samples inside their part, and the part's summary: its records
    from both sides and its lowest sample."""
    height = table.column("height").to_numpy()
    ends = np.concatenate((first[1:], [True]))
    left, left_open = _look_left(height, first)
    right, right_open = _look_left(height[::-1], ends[::-1])
    right, right_open = right[::-1], right_open[::-1]
    from_left = _records(height, first)
    from_right = _records(height[::-1], ends[::-1])[::-1]

    keep = from_left | from_right
    lowest = np.lexsort((height, np.cumsum(first)))[np.flatnonzero(first)]
    keep[lowest] = True
    summary = np.flatnonzero(keep)
    queried = np.flatnonzero(table.column("query").to_numpy(zero_copy_only=False))
    rows = np.concatenate((queried, summary))
    is_query = np.concatenate((np.ones(len(queried), bool), np.zeros(len(summary), bool)))
    out = table.select(["series", "sign", "part", "pos", "tag", "height"]).take(pa.array(rows))
    for name, values in (
        ("query", is_query), ("left", left[rows]), ("left_open", left_open[rows]),
        ("right", right[rows]), ("right_open", right_open[rows]),
        ("from_left", from_left[rows]), ("from_right", from_right[rows]),
    ):
        out = out.append_column(name, pa.array(values))
    return out


_SCAN_SCHEMA = (
    "series STRING, sign INT, part BIGINT, pos BIGINT, tag BIGINT, height DOUBLE, query BOOLEAN, "
    "left DOUBLE, left_open BOOLEAN, right DOUBLE, right_open BOOLEAN, "
    "from_left BOOLEAN, from_right BOOLEAN"
)

# What a part sees to one side: ``target``, the first part that holds anything higher than a height
# from ``above`` on and below the target's ``top``; ``floor``, the lowest sample of the parts between;
# no target for heights that nothing on that side exceeds. ``own_top`` is the part's own highest sample.
_SIGHT_SCHEMA = (
    "series STRING, sign INT, side INT, part BIGINT, target BIGINT, above DOUBLE, top DOUBLE, "
    "floor DOUBLE, own_top DOUBLE"
)
_SIGHT_BATCH = 10_000


def _sights(batches):
    """Sights of every part from one row per part, in the order of looking (sides apart).

    A stack of parts with falling tops. A part sees those that it takes off the stack, and the first
    that is higher than itself; each part is taken off once, so there are two sights per part and side
    at most, whatever the series looks like. Only the stack is held.
    """
    names = ["series", "sign", "side", "part", "target", "above", "top", "floor", "own_top"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
    now, stack, out = None, [], []

    def flushed():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(values), kind) for values, kind in zip(zip(*out), types)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("series", "sign", "side", "part", "top", "low")]
        for *key, part, top, low in zip(*columns):
            if key != now:
                now, stack = key, []
            above, floor = -np.inf, np.inf
            while stack:
                target, target_top, target_low = stack[-1]
                out.append((*key, part, target, above, target_top, floor, top))
                if target_top > top:
                    break
                above, floor = max(above, target_top), min(floor, target_low)
                stack.pop()
            else:
                out.append((*key, part, None, above, np.inf, floor, top))
            stack.append((part, top, min(low, floor)))
            if len(out) >= _SIGHT_BATCH:
                yield flushed()
                out = []
    if out:
        yield flushed()


QUERY, RECORD, SEES, SEEN = 0, 1, 2, 3

_MEETING_SCHEMA = (
    "series STRING, sign INT, side INT, part BIGINT, target BIGINT, role INT, pos BIGINT, tag BIGINT, "
    "height DOUBLE, floor DOUBLE"
)


def _meetings(table: pa.Table, first: np.ndarray) -> pa.Table:
    """Send the open samples of each part, and the records of each part that is seen, to where they meet.

    Groups are (series, sign, side, here). The height ranges in which different parts see the same
    target do not overlap, so a record is sent once, but for one more at the end of each range.
    """
    role, height, floor, above, top, own_top = (
        table.column(c).to_numpy() for c in ("role", "height", "floor", "above", "top", "own_top"))
    rows, parts, targets, floors = [], [], [], []
    here = table.column("here").to_numpy()
    other = table.column("other")
    none = other.is_null().to_numpy()
    other = other.fill_null(-1).to_numpy()
    starts = np.flatnonzero(first)
    for a, b in zip(starts, np.append(starts[1:], len(first))):
        kinds = role[a:b]
        asked, record, sees, seen = (np.flatnonzero(kinds == k) + a for k in (QUERY, RECORD, SEES, SEEN))
        if len(asked):
            sees = sees[np.argsort(top[sees], kind="stable")]
            sight = sees[np.searchsorted(top[sees], height[asked], "right")]
            rows.append(asked)
            parts.append(here[asked])
            targets.append(np.where(none[sight], -1, other[sight]))
            floors.append(floor[sight])
        if len(record) and len(seen):
            record = record[np.argsort(height[record], kind="stable")]
            low = np.searchsorted(height[record], above[seen], "right")
            high = np.minimum(np.searchsorted(height[record], own_top[seen], "right") + 1, len(record))
            count = np.maximum(high - low, 0)
            at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
            rows.append(record[at])
            parts.append(np.repeat(other[seen], count))
            targets.append(here[record[at]])
            floors.append(floor[record[at]])
    rows, parts, targets = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, parts, targets))
    out = table.select(["series", "sign", "side"]).take(pa.array(rows))
    for name, values in (("part", pa.array(parts, pa.int64())), ("target", pa.array(targets, pa.int64(), mask=targets < 0))):
        out = out.append_column(name, values)
    for name in ("role", "pos", "tag", "height"):
        out = out.append_column(name, table.column(name).take(pa.array(rows)))
    return out.append_column("floor", pa.array(np.concatenate(floors) if floors else np.zeros(0), pa.float64()))


def _met(table: pa.Table, first: np.ndarray) -> pa.Table:
    """Floors of open samples up to the last higher sample of the part that they see."""
    height, floor = table.column("height").to_numpy(), table.column("floor").to_numpy().copy()
    asked = table.column("role").to_numpy() == QUERY
    starts = np.flatnonzero(first)
    for a, b in zip(starts, np.append(starts[1:], len(first))):
        own = np.flatnonzero(asked[a:b]) + a
        records = np.flatnonzero(~asked[a:b]) + a
        if len(own) and len(records):
            records = records[np.argsort(height[records], kind="stable")]
            last = records[np.searchsorted(height[records], height[own], "right")]
            floor[own] = np.minimum(floor[own], floor[last])
    out = table.select(["series", "sign", "side", "pos", "tag"]).filter(pa.array(asked))
    return out.append_column("floor", pa.array(floor[asked]))


def _beyond(scanned: DataFrame) -> DataFrame:
    """Meetings of open samples and records, one group for each pair of parts that see each other:
    (series, sign, side, part, target) with at most two parts' rows each."""
    key = ["series", "sign", "side"]
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    extents = scanned.where("NOT query").groupBy("series", "sign", "part").agg(
        F.max("height").alias("top"), F.min("height").alias("low")).select("*", sides)
    # The right side is looked at from the last part to the first.
    looking = F.when(F.col("side") == 0, F.col("part")).otherwise(-F.col("part"))
    sights = materialize(
        extents.repartition(*key).withColumn("order", looking).sortWithinPartitions(*key, "order")
        .mapInArrow(_sights, _SIGHT_SCHEMA), "sights")

    def rows(df: DataFrame, role: int, here: str, other, **columns) -> DataFrame:
        given = {"pos": "bigint", "tag": "bigint", "height": "double", "floor": "double",
                 "above": "double", "top": "double", "own_top": "double"}
        return df.select(
            *key, F.col(here).alias("here"), other.cast("bigint").alias("other"), F.lit(role).alias("role"),
            *[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in given.items()])

    nothing, c = F.lit(None), F.col
    parts = []
    for side, (towards, back, back_floor) in enumerate(
            (("left_open", "from_right", "right"), ("right_open", "from_left", "left"))):
        sided = scanned.withColumn("side", F.lit(side))
        parts.append(rows(sided.where(c("query") & c(towards)), QUERY, "part", nothing,
                          pos=c("pos"), tag=c("tag"), height=c("height")))
        parts.append(rows(sided.where(~c("query") & c(back)), RECORD, "part", nothing,
                          pos=c("pos"), height=c("height"), floor=c(back_floor)))
    bounds = {name: c(name) for name in ("above", "top", "own_top", "floor")}
    parts.append(rows(sights, SEES, "part", c("target"), **bounds))
    parts.append(rows(sights.where("target IS NOT NULL"), SEEN, "target", c("part"), **bounds))
    together = parts[0]
    for more in parts[1:]:
        together = together.unionByName(more)
    return (
        together.repartition(*key, "here").sortWithinPartitions(*key, "here")
        .mapInArrow(over_groups(_meetings, (*key, "here")), _MEETING_SCHEMA))


def _floors(samples: DataFrame) -> DataFrame:
    """Valley floors (``left``, ``right``) of the queried samples over the whole series.

    ``samples`` has series, sign, part, pos, tag, height and query. Each part is scanned alone. A
    sample that is open to a side is at least as high as everything on that side of its part. From
    one row per part (its highest and lowest sample) it is known which other part ends its view, and
    there only that part's records count, those higher than all that follows in it. So a group
    never holds more than two parts' rows, even if every sample of the series is a record.
    """
    scanned, seen = measured(
        samples.repartition("series", "sign", "part")
        .sortWithinPartitions("part", "series", "sign", "pos")
        .mapInArrow(over_groups(_scan_groups, ("series", "sign", "part")), _SCAN_SCHEMA), "scan",
        last=F.max("part"))
    asked = scanned.where("query").select("series", "sign", "pos", "tag", "height", "left", "right")
    if not seen["last"]:
        return asked
    key = ["series", "sign", "side", "part", "target"]
    outer = (
        _beyond(scanned).repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(over_groups(_met, key), "series STRING, sign INT, side INT, pos BIGINT, tag BIGINT, floor DOUBLE"))
    floor = {name: F.when(F.col("side") == side, F.col("floor")) for side, name in enumerate(("left", "right"))}
    return asked.unionByName(outer.select(
        "series", "sign", "pos", "tag", F.lit(None).cast("double").alias("height"),
        *[column.alias(name) for name, column in floor.items()],
    )).groupBy("series", "sign", "pos", "tag").agg(
        F.max("height").alias("height"), F.min("left").alias("left"), F.min("right").alias("right"))


def prominences(points: DataFrame) -> DataFrame:
    """(series, kind, mid, value, prominence) of every local extremum of stored turning points."""
    signed = points.select(
        "series", "pos", "mid", "value", "kind", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    wanted = F.when(F.col("sign") == 1, F.lit("max")).otherwise(F.lit("min"))
    samples = signed.select(
        "series", "sign", floor_div(F.col("pos"), CHUNK_ROWS).alias("part"), "pos",
        F.col("mid").alias("tag"), (F.col("value") * F.col("sign")).alias("height"),
        (F.col("kind") == wanted).alias("query"))
    floors = _floors(samples)
    return floors.select(
        "series", wanted.alias("kind"), F.col("tag").alias("mid"),
        (F.col("height") * F.col("sign")).alias("value"),
        (F.col("height") - F.greatest("left", "right")).alias("prominence"))


def peaks_of(points: DataFrame) -> DataFrame:
    """Local extrema with a ``height`` that is the negated value for minima."""
    height = F.when(F.col("kind") == "max", F.col("value")).otherwise(-F.col("value"))
    return points.where(F.col("kind") != "end").select(
        "series", "kind", "mid", height.alias("height"), "us", "ord")


def find_extrema(smooth: DataFrame, prominence: float = PROMINENCE, distance: int = DISTANCE) -> DataFrame:
    """Minima and maxima of a smooth series: (series, kind, mid, us, ord, value, prominence)."""
    points = materialize(turning_points(smooth), "turning")
    spaced = min_distance(peaks_of(points), distance)
    high = prominences(points).where(F.col("prominence") >= prominence)
    return spaced.select("series", "kind", "mid", "us", "ord").join(high, ["series", "kind", "mid"])
