"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and stars.

* One hash of each shingle serves the whole signature: its upper part chooses one of ``BANDS * ROWS`` bins,
  and a bin keeps its least hash. An empty bin copies a filled one, the first that its own fixed sequence of
  random bins meets, so that texts with few shingles still agree bin by bin as often as they are similar.
* Texts with equal shingle sets are one class. Classes that agree on all bins of a band share a bucket. A
  bucket becomes a star: an edge from its least class to every other, never all its pairs.
* Edges whose sizes or signatures rule out a link go; the rest are confirmed on the full sets. Each class's edge to
  the least centre it meets comes first; of the others only those between components are left to test.
* What stars leave open is settled exactly: in a bucket whose classes are not yet connected, blocks of classes
  are compared by signature, and what may be linked is verified on full sets in blocks of bounded bytes. Only
  pairs of different components are looked at, and only links that connect something leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import bounds, gathered, pick, pieces, stored
from gaugeflow.llm.graph import components
from gaugeflow.llm.jaccard import shingle_sets
from gaugeflow.llm.rolling import Powers, mix, spread

SHINGLE = 2
PERCENT = 80
# A pair at the threshold of 80 % shares no bucket with probability (1 - 0.8**5)**32, three in a million.
BANDS = 32
ROWS = 5
# How far below the threshold the share of agreeing bins may lie: over six standard deviations.
MARGIN = 0.2

# Classes of a block, and bytes of their sets.
BLOCK = 512
BLOCK_BYTES = 8 << 20


def one_permutation(rows: np.ndarray, hashes: np.ndarray, count: int, bins: int) -> np.ndarray:
    """uint16 signatures (one row each) of sets given as sorted (row, hash); zeros for empty sets."""
    out = np.zeros((count, bins), np.uint16)
    filled = np.zeros((count, bins), bool)
    if len(rows):
        # The order of hashes is the order of bins, so the first of a bin is its least.
        bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (bin_[1:] != bin_[:-1])
        out[rows[first], bin_[first]] = (mix(hashes[first]) >> np.uint64(48)).astype(np.uint16)
        filled[rows[first], bin_[first]] = True
    row, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    turn = 0
    while len(row):
        chosen = (spread(81 + turn, bins) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
        source = chosen.astype(np.int64)[empty]
        hit = filled[row, source]
        out[row[hit], empty[hit]] = out[row[hit], source[hit]]
        row, empty = row[~hit], empty[~hit]
        turn += 1
    return out


def _lowered_sets(texts: pa.Array, powers: list[Powers], size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(pc.ascii_lower(texts), powers, size)


def _signed(size: int, bands: int, depth: int):
    """Rows with the size, a 128-bit fingerprint and the signature of their set, and a key for each band."""

    def run(batches):
        powers = [Powers(31), Powers(32)]
        for batch in batches:
            for part in pieces(batch, limit=2 << 20):
                count = part.num_rows
                rows, hashes = _lowered_sets(part.column("text"), powers, size)
                n = np.bincount(rows, minlength=count)
                edges = np.searchsorted(rows, np.arange(count + 1))
                prints = []
                for salt in (51, 52):
                    sums = np.zeros(len(rows) + 1, np.uint64)
                    np.cumsum(mix(hashes + spread(salt, 1)), out=sums[1:])
                    prints.append(pa.array((sums[edges[1:]] - sums[edges[:-1]]).view(np.int64)))
                sig = one_permutation(rows, hashes, count, bands * depth)
                steps = sig.reshape(count, bands, depth).astype(np.uint64)
                key = np.broadcast_to(spread(61, bands), steps.shape[:2]).copy()
                for level in range(depth):
                    key = mix(key ^ steps[:, :, level] + np.uint64(level << 20))
                code = (sig & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text"), pa.array(n, pa.int64()), *prints,
                    pa.array([c.tobytes() for c in code], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * bands, pa.int32()),
                                             pa.array(key.view(np.int64).ravel()))],
                    ["doc_id", "text", "n", "high", "low", "code", "keys"])

    return run


def _codes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity: the share of equal bins, less what equal bytes of different bins add."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _possible(percent: int, bins: int):
    """Edges whose sizes and signatures allow a link."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = np.sort(np.stack([batch.column("na").to_numpy(), batch.column("nb").to_numpy()]), axis=0)
            alike = _alike(_codes(batch.column("ca"), bins), _codes(batch.column("cb"), bins))
            keep = (100 * n[0] >= percent * n[1]) & (alike >= percent / 100 - MARGIN)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _ranges(first: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray):
    """For rows sorted by own block: each row and the range of later rows that it is to be compared with."""
    for start, end in bounds(first):
        split = start + int(np.searchsorted(own[start:end], j[start]))
        for x in range(start, end if i[start] == j[start] else split):
            low = x + 1 if i[start] == j[start] else split
            if low < end:
                yield x, low, end


class _Joined:
    """Components of rows of a task that links have connected so far."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]
        self.left, self.right = [], []

    def link(self, x: int, others: np.ndarray) -> None:
        for y in others[np.unique(self.label[others], return_index=True)[1]]:
            if self.label[y] != self.label[x]:
                self.label[self.label == self.label[y]] = self.label[x]
                self.left.append(x)
                self.right.append(int(y))


def _open_pairs(column: dict, code: np.ndarray, first: np.ndarray, percent: int, label):
    """Each row and the rows that it may be linked with but is not connected with, by ``label()``."""
    n = column["n"]
    for x, low, high in _ranges(first, column["i"], column["j"], column["own"]):
        now = label()
        near = np.flatnonzero((now[low:high] != now[x]) & (100 * np.minimum(n[low:high], n[x]) >= percent * np.maximum(
            n[low:high], n[x]))) + low
        if len(near):
            near = near[_alike(code[near], code[x]) >= percent / 100 - MARGIN]
        if len(near):
            yield x, near


def _likely(percent: int, bins: int):
    """In blocks of a bucket: the classes that may be linked across components (``node``), and edges (a, b)
    that connect the components concerned, a forest of them."""

    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("i", "j", "own", "node", "n", "component")}
        met, joined = np.zeros(len(first), bool), _Joined(column["component"])
        for x, near in _open_pairs(column, _codes(table.column("code"), bins), first, percent,
                                   lambda: column["component"]):
            met[x] = True
            met[near] = True
            joined.link(x, near)
        none = [None] * len(joined.left)
        nodes = np.unique(column["node"][met])
        return pa.table({
            "node": pa.array([*nodes.tolist(), *none], pa.int64()),
            "a": pa.array([None] * len(nodes) + column["component"][joined.left].tolist(), pa.int64()),
            "b": pa.array([None] * len(nodes) + column["component"][joined.right].tolist(), pa.int64())})

    return gathered(compute, ("key", "i", "j"), 8 << 20)


def _verified(percent: int, bins: int):
    """In blocks of a group: links on full sets that connect different components."""

    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("i", "j", "own", "node", "n", "component")}
        sets = table.column("shingles").combine_chunks()
        value, offset = sets.values.to_numpy(), sets.offsets.to_numpy()
        # A component may reach into several groups of the table, so its label goes by group.
        group = np.cumsum(first) - 1
        joined = _Joined(np.unique(np.stack([group, column["component"]]), axis=1, return_inverse=True)[1].ravel())
        for x, near in _open_pairs(column, _codes(table.column("code"), bins), first, percent, lambda: joined.label):
            own = value[offset[x]:offset[x + 1]]
            both = np.array([len(np.intersect1d(own, value[offset[y]:offset[y + 1]], assume_unique=True)) for y in near])
            joined.link(x, near[100 * both >= percent * (len(own) + column["n"][near] - both)])
        return pa.table({"a": column["node"][joined.left], "b": column["node"][joined.right]},
                        schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return gathered(compute, ("component_group", "i", "j"), 2 * BLOCK_BYTES)


def _in_blocks(df: DataFrame, blocks: Column, node: str = "node") -> DataFrame:
    """A row for every pair of blocks of its group that a member takes part in."""
    df = df.withColumn("blocks", blocks.cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), F.col(node)), F.col("blocks")).cast("int"))
    return df.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({
        "i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def _full_sets(signed: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted classes, from the text of each one's row."""

    def run(batches):
        powers = [Powers(31), Powers(32)]
        for batch in batches:
            for part in pieces(batch, limit=2 << 20):
                rows, hashes = _lowered_sets(part.column("text"), powers, size)
                edges = np.searchsorted(rows, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(
                    pa.array(edges, pa.int32()), pa.array(hashes.view(np.int64)))], ["node", "shingles"])

    wanted = classes.join(nodes, "node").select("row", "node")
    return signed.select("row", "text").join(wanted, "row").select("node", "text").mapInArrow(
        run, "node BIGINT, shingles ARRAY<BIGINT>")


def _confirmed(edges: DataFrame, signed: DataFrame, classes: DataFrame, percent: int, size: int, bins: int) -> DataFrame:
    """Those of the edges (a, b) that are links: first by sizes and signatures, then on full sets."""
    sides = {s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("code").alias(f"c{s}"))
             for s in "ab"}
    stars, seen = stored(
        edges.join(sides["a"], "a").join(sides["b"], "b").mapInArrow(_possible(percent, bins), "a BIGINT, b BIGINT"),
        "stars")
    if not seen["rows"]:
        return stars
    ends = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets, _ = stored(_full_sets(signed, classes, ends, size), "sets")
    whole = stars
    for side in "ab":
        whole = whole.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")), side)
    both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return whole.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either")).where(
        F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


def _merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (node, component) after further links (a, b). The graph of its components is what is
    connected, so the many links between two components count once."""
    pairs = links
    for side in "ab":
        pairs = pairs.join(named.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
    pairs, seen = stored(pairs.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "pairs")
    if not seen["rows"]:
        return named
    moved = components(pairs).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return stored(named.join(moved, "component", "left").select(
        "node", F.coalesce("joined", "component").alias("component")), "named")[0]


def _open_links(signed: DataFrame, classes: DataFrame, buckets: DataFrame, named: DataFrame, percent: int, size: int,
                bins: int) -> DataFrame | None:
    """Links across components inside buckets, beyond the stars; None if there is nothing to compare."""
    # All pairs with a bucket's centre are settled.
    rest = buckets.where("size > 2 AND node <> centre").select("key", "node").join(named, "node")
    split = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("least"),
                                    F.max("component").alias("most")).where("least < most").select("key", "size")
    rest, seen = stored(rest.join(split, "key"), "rest")
    if not seen["rows"]:
        return None
    columns = ["i", "j", "own", "node", "n", "component", "code"]
    likely, seen = stored(
        _in_blocks(rest.join(classes.select("node", "n", "code"), "node"), F.ceil(F.col("size") / BLOCK))
        .select("key", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
        .mapInArrow(_likely(percent, bins), "node BIGINT, a BIGINT, b BIGINT"), "likely")
    if not seen["rows"]:
        return None
    groups = components(likely.where("a IS NOT NULL").select("a", "b").distinct()).select(
        F.col("node").alias("component"), F.col("component").alias("component_group"))
    members, _ = stored(
        likely.where("node IS NOT NULL").select("node").distinct().join(named, "node").join(groups, "component")
        .join(classes.select("node", "n", "code"), "node"), "members")
    sizes = members.groupBy("component_group").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("many"))
    sets = _full_sets(signed, classes, members.select("node"), size)
    return (
        _in_blocks(members.join(sizes, "component_group").join(sets, "node"), F.col("many"))
        .select("component_group", *columns, "shingles").repartition("component_group", "i", "j")
        .sortWithinPartitions("component_group", "i", "j", "own")
        .mapInArrow(_verified(percent, bins), "a BIGINT, b BIGINT"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Two rows are linked if their sets of ``size``-word shingles (A-Z as a-z) share at least ``percent`` of
    their union. Texts with fewer words than a shingle have one, all their words. component_id is the least
    doc_id that links reach, the row itself included; kept marks rows that carry it. Null texts and texts
    without words have no shingles, are linked with nothing and are kept. A null doc_id is passed over when
    components are named; a component without any other has a null name and its rows are kept. Repeated rows
    count each, and all rows of the least doc_id are kept. Other columns are ignored; an empty table gives
    an empty result. Sets are compared by 64-bit hashes of shingles, equal sets are found by 128 bits.
    """
    bins = bands * rows
    signed, _ = stored(
        pick(docs, "doc_id", "text").mapInArrow(
            _signed(size, bands, rows), "doc_id BIGINT, text STRING, n BIGINT, high BIGINT, low BIGINT, code BINARY, keys ARRAY<BIGINT>")
        .withColumn("row", F.monotonically_increasing_id()), "signed")
    # A class goes by the number of one of its rows in the stored table.
    groups = signed.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
    classes, _ = stored(
        signed.select("row", "n", "code", "keys").join(groups, "row").withColumn("node", F.col("row")), "classes")
    ends = classes.select("node", F.explode("keys").alias("key"))
    met = ends.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets, _ = stored(ends.join(met, "key"), "buckets")
    arms = buckets.where("node <> centre").select("node", "centre")
    # One edge of each class first, to the least centre it meets. That connects most of what belongs together,
    # and of the other edges only those between different components are left to test.
    first, _ = stored(arms.groupBy("node").agg(F.min("centre").alias("tested")), "first")
    named = classes.select("node", F.col("node").alias("component"))
    named = _merged(named, _confirmed(
        first.select(F.col("node").alias("a"), F.col("tested").alias("b")), signed, classes, percent, size, bins))
    other = arms.join(first, "node").where("centre <> tested").select("node", "centre").distinct().join(named, "node").join(
        named.select(F.col("node").alias("centre"), F.col("component").alias("theirs")), "centre").where(
        "component <> theirs").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    named = _merged(named, _confirmed(other, signed, classes, percent, size, bins))
    more = _open_links(signed, classes, buckets, named, percent, size, bins)
    if more is not None:
        named = _merged(named, more)
    labelled = classes.select("node", "high", "low", "least").join(named, "node")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    info = labelled.select("high", "low", "component").join(least, "component").select("high", "low", "component_id")
    found = signed.where("n > 0").select("doc_id", "n", "high", "low").join(info, ["high", "low"], "left")
    alone = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n", "component_id").unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
