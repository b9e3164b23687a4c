"""Quality classifier by positive-unlabelled learning.

Trusted positives are sampled texts labelled 1; all sampled texts, whatever their label, are the
unlabelled web text. A small network minimises the non-negative unbiased risk

    prior * E_pos[loss(+1)] + max(0, E_unl[loss(-1)] - prior * E_pos[loss(-1)])

with the class prior estimated from the same two sets (:func:`class_prior`), and its boundary is placed by the
prior. A label 0 teaches nothing. Features describe the whole text: trigrams of byte classes, and shares of repeated words and windows. The network is fitted on a bounded
sample; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import pick, pieces, text_bytes
from gaugeflow.llm.rolling import Powers, window_hashes, word_hashes, word_spans

# Documents in the sample that the network is fitted on (about this many, never more).
SAMPLE_DOCS = 16_000
HIDDEN = 32
EPOCHS = 60
PRIOR_EPOCHS = 25
# Class prior, and score, where no text is labelled 1.
PRIOR = 0.5

# Classes of bytes: other, space, line end, lower case, upper case, digit, sentence mark, other mark.
_CLASS = np.zeros(256, np.int64)
_CLASS[[32, 9]] = 1
_CLASS[[10, 11, 12, 13]] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
TRIGRAMS = 8 ** 3
SHAPES = 12


def _distinct(rows: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of different hashes, and how often the most frequent one occurs."""
    if not len(rows):
        return np.zeros(count), np.zeros(count)
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1]))))
    most = np.zeros(count)
    np.maximum.at(most, r[starts], np.diff(np.append(starts, len(r))))
    return np.bincount(r[starts], minlength=count).astype(float), most


def features(texts: pa.StringArray, powers: list[Powers]) -> np.ndarray:
    """One row of float32 features per text; null and empty texts give zeros."""
    data, offsets = text_bytes(texts)
    count = len(texts)
    size = np.diff(offsets)
    kinds = _CLASS[data]
    grams = np.zeros((count, TRIGRAMS), np.float32)
    if len(data) > 2:
        row = np.repeat(np.arange(count), size)
        whole = row[:-2] == row[2:]
        codes = kinds[:-2] * 64 + kinds[1:-1] * 8 + kinds[2:] + row[:-2] * TRIGRAMS
        grams = np.bincount(codes[whole], minlength=count * TRIGRAMS).reshape(count, TRIGRAMS).astype(np.float32)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, 2, powers[0])
    n = np.diff(first)
    owner = np.repeat(np.arange(count), n)
    some = np.maximum(n, 1)
    repeat = np.zeros(count)
    if len(words) > 1:
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        repeat = np.bincount(owner[1:][again], minlength=count)
    unique, most = _distinct(owner, words, count)
    windows, at = window_hashes(words, first, 4, powers[1])
    held = np.bincount(owner[at], minlength=count)
    unique4, most4 = _distinct(owner[at], windows, count)
    lines = np.bincount(np.repeat(np.arange(count), size)[data == 10], minlength=count)
    length = np.bincount(owner, weights=ends - starts, minlength=count)
    shape = np.stack([
        np.log1p(size), np.log1p(n), length / some, repeat / some, unique / some, most / some,
        unique4 / np.maximum(held, 1), most4 / np.maximum(held, 1), np.log1p(lines), lines / some,
        unique / np.sqrt(some), (n == 0).astype(float)], axis=1)
    shares = np.sqrt(grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))
    return np.concatenate([shape.astype(np.float32), shares.astype(np.float32)], axis=1)


class Network:
    """One hidden layer; standardised inputs."""

    def __init__(self, inputs: np.ndarray, hidden: int, seed: int):
        draw = np.random.default_rng(seed)
        self.mean = inputs.mean(axis=0)
        self.scale = inputs.std(axis=0) + 0.02
        width = inputs.shape[1]
        self.weights = [
            (draw.standard_normal((width, hidden)) * np.sqrt(1 / width)).astype(np.float32),
            np.zeros(hidden, np.float32),
            (draw.standard_normal(hidden) * np.sqrt(1 / hidden)).astype(np.float32), np.zeros(1, np.float32)]

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, self.mean, self.scale, *self.weights)
        return out.getvalue()

    @classmethod
    def loaded(cls, saved: bytes) -> Network:
        net = cls.__new__(cls)
        with np.load(io.BytesIO(saved)) as arrays:
            net.mean, net.scale, *net.weights = (arrays[name] for name in arrays.files)
        return net

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.weights[0] + self.weights[1], 0)
        return hidden, hidden @ self.weights[2] + self.weights[3]

    def gradients(self, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        back = np.outer(slope, self.weights[2]) * (hidden > 0)
        return [x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(keepdims=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.forward(self.scaled(x))[1].astype(float), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7,
        hidden: int = HIDDEN, epochs: int = EPOCHS, decay: float = 1e-4) -> Network:
    """Minimise the non-negative risk by Adam; a step that would make the negative risk fall below
    zero climbs it again instead. The sigmoid loss is l(z) = 1 / (1 + exp(z))."""
    net = Network(np.concatenate([positive, unlabelled]), hidden, seed)
    pos, unl = net.scaled(positive), net.scaled(unlabelled)
    draw = np.random.default_rng(seed)
    batch = 256
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    steps = max(1, len(unl) // batch)
    for step in range(1, epochs * steps + 1):
        p = pos[draw.integers(0, len(pos), batch)]
        u = unl[draw.integers(0, len(unl), batch)]
        x = np.concatenate([p, u])
        hid, z = net.forward(x)
        loss = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        curve = loss * (1 - loss)
        zero = np.zeros(batch, np.float32)
        missed = -prior * curve[:batch] / batch
        negative = (1 - loss[batch:]).mean() - prior * (1 - loss[:batch]).mean()
        wrong = np.concatenate([-prior * curve[:batch], curve[batch:]]) / batch
        if negative >= 0:
            slope = np.concatenate([missed, zero]) + wrong
        else:
            slope = -wrong
        rate = 0.003 * min(1.0, 3 * (1 - step / (epochs * steps + 1)))
        for k, g in enumerate(net.gradients(x, hid, slope.astype(np.float32))):
            g = g + decay * net.weights[k]
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            net.weights[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, x: np.ndarray, seed: int = 7, epochs: int = PRIOR_EPOCHS,
                chance: float = 0.1) -> float:
    """Share of good texts among all rows of ``x``, where those marked in ``positive`` are known to be good.

    A score is learned on half of the rows, telling known good ones from all. On the other half, the rows above
    a bound hold as large a share of all good texts as of the known ones, so the least ratio of the share of all
    rows to that of known good ones above any bound is the prior, where only good texts lie above it. The ratio
    is taken where its upper confidence bound is least, so a few top rows do not decide. Both halves are averaged.
    """
    half = np.random.default_rng(seed).permutation(len(x)) % 2 == 0
    found = []
    for side in (half, ~half):
        if not (positive & side).any() or not (positive & ~side).any():
            continue
        net = fit(x[positive & side], x[side], PRIOR, seed, epochs=epochs)
        score = net.forward(net.scaled(x[~side]))[1]
        known, every = np.sort(score[positive[~side]]), np.sort(score)
        share = np.arange(len(known), 0, -1) / len(known)
        ratio = (len(every) - np.searchsorted(every, known)) / len(every) / share
        doubt = sum(np.sqrt(np.log(4 / chance) / 2 / n) for n in (len(known), len(every)))
        found.append(ratio[np.argmin(ratio + doubt / share)])
    return min(1.0, float(np.mean(found))) if found else PRIOR


def place_boundary(net: Network, unlabelled: np.ndarray, prior: float, slack: float = 0.03) -> None:
    """Shift the network so that it is 0 in the widest gap of its outputs near the quantile at which
    the class prior splits the unlabelled texts."""
    z = np.sort(net.forward(net.scaled(unlabelled))[1].astype(float))
    low = max(0, int((1 - prior - slack) * len(z)))
    high = min(len(z) - 1, int((1 - prior + slack) * len(z)))
    if high > low:
        widest = low + int(np.argmax(np.diff(z[low:high + 1])))
        net.weights[3] -= np.float32((z[widest] + z[widest + 1]) / 2)


def _featured(batches):
    powers = [Powers(21), Powers(22)]
    for batch in batches:
        for part in pieces(batch, limit=2 << 20):
            x = features(part.column("text"), powers)
            flat = pa.array(x.ravel())
            size = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("order"), pa.ListArray.from_arrays(size, flat)],
                ["label", "order", "x"])


def _fitted(batches):
    """One row with the network fitted on all rows of a task and the class prior; none if no text is labelled
    1, and no network if all are."""
    labels, rows = [], []
    for batch in batches:
        labels.append(batch.column("label").fill_null(-1).to_numpy())
        rows.append(batch.column("x").flatten().to_numpy().reshape(-1, TRIGRAMS + SHAPES))
    if rows:
        good, x = np.concatenate(labels) == 1, np.concatenate(rows)
        if good.any():
            net, prior = None, 1.0
            if not good.all():
                prior = class_prior(good, x)
                net = fit(x[good], x, prior)
                place_boundary(net, x, prior)
            yield pa.RecordBatch.from_arrays(
                [pa.array([net and net.saved()], pa.binary()), pa.array([prior])], ["net", "prior"])


def _scored(net: Network | None, constant: float):
    def run(batches):
        powers = [Powers(21), Powers(22)]
        for batch in batches:
            for part in pieces(batch, limit=2 << 20):
                score = np.full(part.num_rows, constant) if net is None else net.score(
                    features(part.column("text"), powers))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(part.num_columns)], pa.array(score, pa.float64())],
                    [*part.schema.names, "score"])

    return run


def remainder(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the document's id as text, modulo ``folds``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_docs: int = SAMPLE_DOCS) -> tuple:
    """(network, prior) from a hash sample of ``docs``; ``labels`` has doc_id and label, and only its
    rows where ``learn_from`` holds are read. The network is None if no text of the sample is labelled 1, or all
    are. Rows with one doc_id are sampled all or none, with its label."""
    known = labels.where(learn_from & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    total = docs.count()
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    kept = F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * sample_docs / max(total, 1)))
    sample = (
        docs.where(kept).join(known.where(kept), "doc_id", "left")
        .select("label", order.alias("order"), "text")
        .mapInArrow(_featured, "label INT, order BIGINT, x ARRAY<FLOAT>")
        .orderBy("order", "label").limit(sample_docs))
    # The sample is fitted where it lies, in the one partition of its limit; only weights come back.
    fitted = sample.mapInArrow(_fitted, "net BINARY, prior DOUBLE").first()
    if fitted is None:
        return None, PRIOR
    return fitted["net"] and Network.loaded(bytes(fitted["net"])), fitted["prior"]


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1,
                  sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), for every row of ``docs``.

    ``labels`` has doc_id and quality; rows whose crc32(doc_id) modulo ``folds`` is ``held_out_fold``
    are never learned from. Labels other than 0 and 1 are ignored; of several labels of a document the
    lowest counts, and rows with one doc_id share its label; labels 0 are not learned from. Null and empty texts
    get the score of a text without words; without any text labelled 1 every score is 0.5, and if all are, 1. Null doc_ids are not held out. Other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text")
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    fold = remainder("doc_id", folds)
    net, prior = learn(docs, known, fold != held_out_fold, sample_docs)
    return docs.mapInArrow(_scored(net, prior), "doc_id BIGINT, text STRING, score DOUBLE").select(
        "doc_id", F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_rejected(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1,
                     sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`score_quality` predicts as 1."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    net, prior = learn(pick(docs, "doc_id", "text"), known, remainder("doc_id", folds) != held_out_fold, sample_docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scored = _scored(net, prior)

    def run(batches):
        for batch in batches:
            held = batch.column("row")
            texts = held.field(held.type.get_field_index("text"))
            for part in scored([pa.RecordBatch.from_arrays([held, texts], ["row", "text"])]):
                good = pa.array(part.column("score").to_numpy() >= 0.5)
                yield pa.RecordBatch.from_arrays([part.column("row").filter(good)], ["row"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
