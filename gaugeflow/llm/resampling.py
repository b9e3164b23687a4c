"""Importance resampling towards a target corpus, on hashed word n-grams with a position-table CRC-32.

* A CRC is linear: that of a byte string is the XOR of what each byte contributes at its distance from the
  string's end, and of a constant of the string's length. ``PositionCrc`` holds the contributions for the
  distances below ``REACH`` in one table, so the words' spans are reduced by one ``bitwise_xor.reduceat``.
  A span that reaches further is cut into blocks counted from its end; each block's value is moved on over
  the bytes behind it by tables of zero bytes (one per power of two) and XORed to the rest.
* A run of words shares its tail with the run that starts one word later, so only the first word's bytes are
  looked up again, at their distance from the new end.
* Buckets are counted by task, summed in Spark, and come back as one row for each bucket.
* Ranks need no task with all rows: what can be drawn is range-partitioned by rank order, numbered within
  partitions, and moved by the partitions' sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import partitions, pick, pieces, stored, text_bytes
from gaugeflow.llm.rolling import word_spans

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42

# Distances from the end that the table covers.
REACH = 128
# Text bytes of the words that are hashed at once.
SLAB = 1 << 20

# Fixed value: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)


class PositionCrc:
    """CRC-32 of word runs from contributions by byte value and distance from the end; A-Z count as a-z."""

    def __init__(self, reach: int = REACH):
        self.reach = reach
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
        self.step = step
        rows = [step]
        for _ in range(reach - 1):
            rows.append(self._over_zero(rows[-1]))
        plain = np.stack(rows)
        lower = np.arange(256)
        lower[65:91] += 32
        self.table = plain[:, lower].ravel()
        self.space = plain[:, 0x20].copy()
        # zeros[p][k]: the state with byte k set, after 2**p zero bytes.
        state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.zeros = [self._over_zero(state)]
        self.constants = self._constant(np.arange(4 * reach))

    def _over_zero(self, state: np.ndarray) -> np.ndarray:
        return (state >> np.uint32(8)) ^ self.step[state & np.uint32(0xFF)]

    def advanced(self, state: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The states after ``count`` zero bytes each."""
        state, power = state.copy(), 0
        most = int(count.max(initial=0))
        while most >> power:
            if power == len(self.zeros):
                self.zeros.append(self._through(self.zeros[-1], self.zeros[-1]))
            moved = np.flatnonzero(count >> power & 1)
            state[moved] = self._through(self.zeros[power], state[moved])
            power += 1
        return state

    @staticmethod
    def _through(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
        low = np.uint32(0xFF)
        return (tables[0][state & low] ^ tables[1][state >> np.uint32(8) & low]
                ^ tables[2][state >> np.uint32(16) & low] ^ tables[3][state >> np.uint32(24)])

    def _constant(self, length: np.ndarray) -> np.ndarray:
        return self.advanced(np.full(len(length), _ONES, np.uint32), length) ^ _ONES

    def constant(self, length: np.ndarray) -> np.ndarray:
        """What a string's length alone contributes."""
        out = self.constants[np.minimum(length, len(self.constants) - 1)]
        far = np.flatnonzero(length >= len(self.constants))
        out[far] = self._constant(length[far])
        return out

    def _space(self, distance: np.ndarray) -> np.ndarray:
        out = self.space[np.minimum(distance, self.reach - 1)]
        far = np.flatnonzero(distance >= self.reach)
        out[far] = self.advanced(np.full(len(far), self.space[0], np.uint32), distance[far])
        return out

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Table places of all bytes of short spans, and where each span begins among them."""
        length = ends - starts
        begin = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(starts - begin, length)
        place = (np.repeat(ends - 1, length) - at) * 256
        place += data[at]
        return place, begin, length

    def _folded(self, data: np.ndarray, start: int, end: int) -> np.uint32:
        """The value of one span of any length, block by block from its end."""
        value = np.uint32(0)
        reach, slab = self.reach, self.reach * max(1, SLAB // self.reach)
        for high in range(end, start, -slab):
            low = max(start, high - slab)
            ends = np.arange(high, low, -reach)
            starts = np.maximum(ends - reach, low)
            place, begin, _ = self._places(data, starts, ends)
            blocks = np.bitwise_xor.reduceat(self.table[place], begin)
            value ^= np.bitwise_xor.reduce(self.advanced(blocks, end - ends))
        return value

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int = LONGEST):
        """For 1 to ``longest`` words: CRCs of the runs that start at each word, joined by one space.

        Runs go over all the words given; the last of k words lack k - 1 of theirs and are left out.
        """
        length = ends - starts
        short, far = np.flatnonzero(length <= self.reach), np.flatnonzero(length > self.reach)
        place, begin, near = self._places(data, starts[short], ends[short])
        word = np.zeros(len(length), np.uint32)
        if len(short):
            word[short] = np.bitwise_xor.reduceat(self.table[place], begin)
        for k in far:
            word[k] = self._folded(data, int(starts[k]), int(ends[k]))

        def moved(behind: np.ndarray) -> np.ndarray:
            """Contributions of each word with so many bytes of the run behind it."""
            fits = length + behind <= self.reach
            out = np.zeros(len(length), np.uint32)
            if len(short):
                shift = np.where(fits, behind, 0)[short] * 256
                out[short] = np.bitwise_xor.reduceat(self.table[place + np.repeat(shift, near)], begin)
            over = np.flatnonzero(~fits)
            out[over] = self.advanced(word[over], behind[over])
            return out

        run, size = word, length
        yield run ^ self.constant(size)
        for _ in range(1, longest):
            if len(run) < 2:
                return
            behind = np.zeros(len(length), np.int64)
            behind[:len(run) - 1] = size[1:] + 1
            run = moved(behind)[:len(run) - 1] ^ self._space(size[1:]) ^ run[1:]
            size = length[:len(run)] + size[1:] + 1
            yield run ^ self.constant(size)


def _separators() -> np.ndarray:
    """What stands between words: every ASCII character but letters and digits."""
    space = np.zeros(256, bool)
    space[:128] = True
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        space[ord(low):ord(high) + 1] = False
    return space


def hashed_runs(texts: pa.StringArray, crc: PositionCrc, buckets: int, longest: int):
    """(words before each row, iterator of (bucket, row) arrays) of all word runs of the texts."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, _separators())

    def portions():
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        last = np.repeat(first[1:], np.diff(first))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLAB, "right")))
            # The next words are read along, so that runs cross the border; those that start there wait.
            e = min(len(starts), j + longest - 1)
            for more, value in enumerate(crc.runs(data, starts[i:e], ends[i:e], longest)):
                value = value[:j - i]
                whole = np.arange(i, i + len(value)) + more < last[i:i + len(value)]
                yield (value[whole] % np.uint32(buckets)).astype(np.int64), row[i:i + len(value)][whole]
            i = j

    return first, portions()


def _counted(buckets: int, longest: int):
    def run(batches):
        crc, counts = PositionCrc(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            side = batch.column("side").to_numpy(zero_copy_only=False)
            for wanted in (0, 1):
                chosen = batch if (side == wanted).all() else batch.filter(pa.array(side == wanted))
                for part in pieces(chosen):
                    for bucket, _ in hashed_runs(part.column("text"), crc, buckets, longest)[1]:
                        counts[wanted] += np.bincount(bucket, minlength=buckets)
        side, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(side.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[side, bucket])],
            ["side", "bucket", "seen"])

    return run


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed share in ``target`` and in ``docs``, rounded down.

    One row for each bucket comes to the driver, whatever the size of the tables.
    """
    texts = docs.select("text", F.lit(0).alias("side")).unionByName(target.select("text", F.lit(1).alias("side")))
    sums = texts.mapInArrow(_counted(buckets, longest), "side INT, bucket INT, seen BIGINT").groupBy("bucket").agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == k, F.col("seen"))), F.lit(0)).alias(name)
          for k, name in ((0, "raw"), (1, "wanted"))])
    raw, wanted = np.zeros(buckets), np.zeros(buckets)
    for line in sums.collect():
        raw[line["bucket"]], wanted[line["bucket"]] = line["raw"], line["wanted"]
    ratio = (wanted + 1) * (raw.sum() + buckets) / ((raw + 1) * (wanted.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(gains: np.ndarray, longest: int):
    def run(batches):
        crc = PositionCrc()
        for batch in batches:
            for part in pieces(batch):
                first, portions = hashed_runs(part.column("text"), crc, len(gains), longest)
                words = np.diff(first)
                weight = np.zeros(len(words), np.int64)
                for bucket, row in portions:
                    if len(row):
                        edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                        weight[row[edge]] += np.add.reduceat(gains[bucket], edge)
                features = sum(np.maximum(words - k, 0) for k in range(longest))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return run


def draw_noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the id: the highest noisy scores are a draw without return."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
                      seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for every row of ``docs`` (doc_id, text).

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100) highest scores are drawn
    and ranked from 1; ties go to the smaller doc_id, a null id last, then to fewer features. Other rows
    have no rank. Words are runs of letters, digits and non-ASCII characters, A-Z taken as a-z; features
    are runs of 1 to 3 words. Null and empty texts have no features and weight 0; a null doc_id counts as
    an empty one in the noise. Repeated rows count each, with ranks of their own. An empty ``target``, or
    one without words, is smoothed like any other; an empty ``docs`` gives an empty result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    gains = bucket_gains(docs, pick(target, "text"))
    able = F.col("n_words") >= min_words
    scored, seen = stored(
        docs.mapInArrow(_weighed(gains, LONGEST), "doc_id BIGINT, n_words BIGINT, n_features BIGINT, weight BIGINT")
        .withColumn("score", F.col("weight") + draw_noise(F.col("doc_id"), seed)), "scored",
        able=F.count_if(able))
    drawn = percent * seen["able"] // 100
    # Only a little more than what is drawn is put in order; the approximate quantile errs by 1 / 10,000.
    low = scored.where(able).agg(F.percentile_approx("score", max(0.0, 1 - (percent + 1) / 100), 10_000)).first()[0]
    while True:
        top = able & (F.col("score") >= low) if low is not None else able
        order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
        # monotonically_increasing_id is the partition's number (upper bits) and the row's place in it.
        placed, found = stored(
            scored.where(top).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
            .withColumn("place", F.monotonically_increasing_id()), "ranked")
        if found["rows"] >= drawn:
            break
        low = None
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    before = [(p, int(s)) for (p, _), s in zip(sizes, np.cumsum([0] + [n for _, n in sizes]))]
    offsets = F.broadcast(spark.createDataFrame(before, "part BIGINT, before BIGINT"))
    place = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = placed.withColumn("part", part).join(offsets, "part").select(
        *names, F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(scored.where(~top).select(*names, F.lit(None).cast("bigint").alias("rank")))
