"""Toxicity classifier with a counterfactual penalty.

A logistic model over the presence of words and word beginnings. For every sampled labelled text that
names a group of people, copies are made in which the name is swapped for each other group; the penalty is
the squared change of the model's output, so that naming a group moves no score. The model is fitted on
a bounded sample of labelled texts; scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import pick, pieces, text_bytes
from gaugeflow.llm.quality import remainder
from gaugeflow.llm.rolling import Powers, word_hashes, word_spans

# Labelled texts in the sample: about this many of either label, never more.
SAMPLE_TOXIC = 6_000
SAMPLE_CLEAN = 8_000
# Hash space and number of chosen features.
SPACE = 1 << 20
CHOSEN = 6_000
# Weight of the counterfactual penalty.
PENALTY = 1.0

# Names of groups of people, by language and kind; each is swapped within its row.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)
# A name of two languages is swapped within either row.
_OTHERS = {name: [other for row in IDENTITY if name in row for other in row if other != name]
           for name in {name for row in IDENTITY for name in row}}
_NAMES = re.compile(r"\b(" + "|".join(sorted(_OTHERS, key=len, reverse=True)) + r")\b", re.IGNORECASE)

# Words here are runs of letters, digits and bytes beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BEGINNINGS = (4, 5, 6)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of the accented letters of the Latin-1 block, in UTF-8."""
    low = _LOWER[data]
    if len(low) > 1:
        accented = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[accented] += 32
    return low


def present(texts: pa.StringArray, powers: Powers, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all different features of each text, sorted; only ``wanted`` ones if given."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, _BREAK)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = lowered(data)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    keys = []
    for seed, length in enumerate((None, *BEGINNINGS)):
        stop = ends if length is None else np.minimum(ends, starts + length)
        use = slice(None) if length is None else ends - starts > length
        feature = (word_hashes(low, starts, stop, 30 + seed, powers)[use] % np.uint64(SPACE)).astype(np.int64)
        row = owner[use]
        if wanted is not None:
            hit = wanted[feature]
            feature, row = feature[hit], row[hit]
        keys.append(np.unique(row * SPACE + feature))
    both = np.unique(np.concatenate(keys))
    return both // SPACE, both % SPACE


def swapped(text: str, turn: int) -> str | None:
    """The text with every group name replaced by another of its kind; None if it names no group."""
    found = False

    def other(match: re.Match) -> str:
        nonlocal found
        found = True
        name = match[0]
        row = _OTHERS[name.lower()]
        put = row[turn % len(row)]
        return put.capitalize() if name[0].isupper() else put

    changed = _NAMES.sub(other, text)
    return changed if found else None


def counterfactuals(text: str) -> list[str]:
    """Copies of a text, so many that every group name in it is swapped for every other one of its kind."""
    turns = max((len(_OTHERS[name.lower()]) for name in _NAMES.findall(text)), default=0)
    return [swapped(text, turn) for turn in range(turns)]


class Model:
    """Weights of the chosen features, and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights.astype(np.float32), bias

    def score(self, texts: pa.StringArray, powers: Powers) -> np.ndarray:
        table = np.zeros(SPACE, np.float32)
        table[self.features] = self.weights
        wanted = np.zeros(SPACE, bool)
        wanted[self.features] = True
        row, feature = present(texts, powers, wanted)
        z = self.bias + np.bincount(row, weights=table[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows)


def choose(row: np.ndarray, feature: np.ndarray, label: np.ndarray, always: np.ndarray) -> np.ndarray:
    """Features whose share differs most between the labels, beyond chance; ``always`` are kept."""
    counts = [np.bincount(feature[label[row] == y], minlength=SPACE).astype(float) for y in (0, 1)]
    totals = [max((label == y).sum(), 1) for y in (0, 1)]
    pooled = (counts[0] + counts[1] + 1) / (totals[0] + totals[1] + 2)
    z = np.abs(counts[1] / totals[1] - counts[0] / totals[0]) / np.sqrt(
        pooled * (1 - pooled) * (1 / totals[0] + 1 / totals[1]))
    z[counts[0] + counts[1] < 3] = 0
    best = np.argsort(-z, kind="stable")[:CHOSEN]
    return np.unique(np.concatenate([best[z[best] > 4], always]))


def fit(row: np.ndarray, feature: np.ndarray, label: np.ndarray, weight: np.ndarray,
        pairs: tuple[np.ndarray, np.ndarray, np.ndarray], penalty: float = PENALTY,
        ridge: float = 1e-4, steps: int = 400) -> Model:
    """Weighted logistic loss + ridge + penalty * mean squared change of the output over ``pairs``.

    ``pairs`` are entries (pair, feature, +1 or -1): features that a swap adds or takes away.
    """
    pair, changed, sign = pairs
    chosen = choose(row, feature, label, np.unique(changed))
    place = np.full(SPACE, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[feature] >= 0
    row, column = row[use], place[feature[use]]
    gap_at = place[changed]
    n, width = len(label), len(chosen)
    share = weight / weight.sum()
    count = max(int(pair.max()) + 1, 1) if len(pair) else 1
    w, base = np.zeros(width), float(np.clip((share * label).sum(), 1e-4, 1 - 1e-4))
    b = np.log(base / (1 - base))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = b + _sums(w[column], row, n)
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        g = np.bincount(column, weights=error[row], minlength=width) + ridge * w
        if len(pair):
            gap = np.bincount(pair, weights=sign * w[gap_at], minlength=count)
            g += 2 * penalty / count * np.bincount(gap_at, weights=sign * gap[pair], minlength=width)
        g = np.append(g, error.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    return Model(chosen, w, float(b))


def _featured(batches):
    powers = Powers(31)
    for batch in batches:
        for part in pieces(batch, limit=2 << 20):
            texts = part.column("text").fill_null("")
            row, feature = present(texts, powers)
            size = np.searchsorted(row, np.arange(part.num_rows + 1))
            own = [feature[a:b] for a, b in zip(size[:-1], size[1:])]
            swaps = []
            for k, text in enumerate(texts.to_pylist()):
                found = []
                for other in counterfactuals(text):
                    new = present(pa.array([other]), powers)[1]
                    gone, come = np.setdiff1d(own[k], new), np.setdiff1d(new, own[k])
                    found.append(np.concatenate([-1 - gone, come]).tolist())
                swaps.append(found)
            yield pa.RecordBatch.from_arrays([
                part.column("label"), part.column("order"),
                pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(feature, pa.int32())),
                pa.array(swaps, pa.list_(pa.list_(pa.int32())))], ["label", "order", "own", "swaps"])


def _scored(model: Model | None, constant: float):
    def run(batches):
        powers = Powers(31)
        for batch in batches:
            for part in pieces(batch, limit=2 << 20):
                score = np.full(part.num_rows, constant) if model is None else model.score(
                    part.column("text"), powers)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def _pairs(swaps: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = [change for of_text in swaps for change in of_text]
    values = np.array([x for change in flat for x in change], np.int64)
    pair = np.repeat(np.arange(len(flat)), [len(change) for change in flat])
    return pair, np.where(values < 0, -1 - values, values), np.where(values < 0, -1.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, penalty: float = PENALTY,
          sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> tuple[Model | None, float]:
    """(model, share of toxic labels) from a hash sample of the labelled texts of either class.

    The model is None unless both labels occur.
    """
    known = labels.where(learn_from & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    limits = {0: sample_clean, 1: sample_toxic}
    shares = {y: min(1.0, 0.9 * limits[y] / max(totals.get(y, 0), 1)) for y in (0, 1)}
    order = F.xxhash64(F.lit("toxic"), F.col("doc_id"))
    cut = F.when(F.col("label") == 1, int((1 << 30) * shares[1])).otherwise(int((1 << 30) * shares[0]))
    sample = known.where(F.pmod(order, F.lit(1 << 30)) < cut)
    rows = (
        docs.join(F.broadcast(sample), "doc_id").select("label", order.alias("order"), "text")
        .mapInArrow(_featured, "label INT, order BIGINT, own ARRAY<INT>, swaps ARRAY<ARRAY<INT>>")
        .orderBy("order", "label").limit(sample_clean + sample_toxic).toArrow())
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    if rows.num_rows == 0:
        return None, share
    label = rows.column("label").to_numpy()
    if label.min() == label.max():
        return None, share
    own = rows.column("own").combine_chunks()
    row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
    feature = own.flatten().to_numpy()
    weight = np.where(label == 1, 1 / shares[1], 1 / shares[0])
    return fit(row, feature, label.astype(float), weight, _pairs(rows.column("swaps").to_pylist()), penalty), share


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0,
                   penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), for every row of ``docs``.

    ``labels`` has doc_id and toxic; rows whose crc32(doc_id) modulo ``folds`` is ``held_out_fold`` are
    never learned from. Labels other than 0 and 1 are ignored; of several labels of a document the
    highest counts. Null and empty texts get the score of a text without words; unless both labels
    occur, every score is the share of toxic labels. Null doc_ids are not held out. Other columns are
    ignored. ``penalty`` 0 switches the counterfactual term off.
    """
    docs = pick(docs, "doc_id", "text")
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label"))
    fold = remainder("doc_id", folds)
    model, share = learn(docs, known, fold != held_out_fold, penalty)
    return docs.mapInArrow(_scored(model, share), "doc_id BIGINT, score DOUBLE").select(
        "doc_id", F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
