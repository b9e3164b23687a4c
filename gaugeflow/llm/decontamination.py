"""Benchmark decontamination by canonical templates.

Texts and benchmark items become sequences of tokens in which numbers, names and units are typed
placeholders. Windows of tokens are hashed and joined; matching windows in step form an alignment of a
text with an item. An alignment counts if it covers enough of the item and if its slots are consistent:
within it, one name or unit of the item always stands for the same one of the text and the other way round,
and fillers keep their type. Of numbers, the largest consistent part counts as covered. So an item is found verbatim, and with other numbers, names or units. A
window that is mostly placeholders matches verbatim only, in any letter case; an alignment counts if capitals
differ where sentences open or where the text has names in small letters, but not if the text has capitals else.

The benchmark's windows are looked up in memory of every task while they are few (their number is
counted); beyond that Spark joins the windows of texts and items by their hashes. Both ways give the
same matches.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import bounds, gathered, pick, pieces, small, stored, text_bytes
from gaugeflow.llm.rolling import Powers, mix, window_hashes, word_hashes, word_spans
from gaugeflow.llm.toxicity import lowered

# Tokens of a window; items with fewer tokens are matched whole.
WINDOW = 8
# Placeholders the template of a window may hold at most, so that it says something. Every window matches by
# its very words too.
MOST_SLOTS = WINDOW // 2
# Share of an item's tokens that an alignment must cover, and fewest tokens.
COVERED = 0.5
# Benchmark windows that tasks look up in memory.
LOOKUP_WINDOWS = 1_000_000

# Units of measure that follow a number.
UNITS = """
    % percent mm cm m km in ft feet foot yd yards mi mile miles inch inches meter meters metre metres
    kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons
    pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute
    minutes h hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent
    cents mph kmh degrees celsius fahrenheit watt watts kw kwh volt volts hz khz mhz ghz kb mb gb tb
""".split()

# Words that open a sentence without being a name.
OPENERS = """
    a about after all also although an and another any are as at be because been before between both but by can
    calculate compute consider could describe determine did do does during each either every explain few find first
    for from give given had has have he her here his how however i if in into is it its let list many may might more
    most must my name no not now of often on once one only or our over prove select she should show since so solve
    some state such suppose than that the their then there these they this those though through to under until up
    use was we were what when where whether which while who whom whose why will with without would write yes you your
""".split()

_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in "\"'()[]{}<>.,;:!?*|#&$"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/+-%eE"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
# Kinds of token.
LITERAL, NUMBER, NAME, UNIT = range(4)
# Sets hashes of very words apart from those of templates.
_VERBATIM = np.uint64(0x4B1D2C6F8E3A5977)
_PLACE = np.array([0, 0x1D3F9A11, 0x2E5C7B22, 0x3F716C33], np.uint64)


class Tokens:
    """Canonical tokens of some texts: kind, canonical hash, hash of the filler, rows' first tokens."""

    def __init__(self, texts: pa.StringArray, powers: Powers):
        data, offsets = text_bytes(texts)
        starts, ends, first = word_spans(data, offsets)
        low = lowered(data)
        rows = np.repeat(np.arange(len(texts)), np.diff(first))
        raw_first = first[rows]
        # Punctuation around a word is no part of it, but a stop before it begins a sentence.
        stop = _STOP[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        begins = np.ones(len(starts), bool)
        begins[1:] = stop[:-1]
        begins[np.arange(len(starts)) == raw_first] = True
        begins |= _after_line_end(data, starts)
        a, b = _stripped(data, starts, ends)
        keep = b > a
        a, b, rows, begins = a[keep], b[keep], rows[keep], begins[keep]
        self.first = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.filler = word_hashes(low, a, b, 71, powers) if len(a) else np.zeros(0, np.uint64)
        self.kind = _kinds(data, low, a, b, begins, rows, self.filler, powers)
        self.begins = begins
        # Words that may be names though they open a sentence.
        self.opener = np.zeros(len(a), bool)
        if len(a):
            self.opener = begins & (self.kind == LITERAL) & _upper(data, low, a) & ~np.isin(
                self.filler, _hashes(OPENERS, powers))


def _after_line_end(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(data == 10)
    count = ends[starts] if len(starts) else np.zeros(0, np.int64)
    out = np.zeros(len(starts), bool)
    out[1:] = count[1:] > count[:-1]
    return out


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks around them; empty (end before start) if they hold nothing else."""
    inner = np.flatnonzero(~_STRIP[data])
    if not len(inner) or not len(starts):
        return ends, starts
    left = np.searchsorted(inner, starts)
    right = np.searchsorted(inner, ends) - 1
    return inner[np.minimum(left, len(inner) - 1)], np.where(right >= left, inner[right] + 1, 0)


def _upper(data: np.ndarray, low: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether the words that start at ``a`` have a capital first."""
    upper = low[a] != data[a]
    return upper | (data[a] == 0xC3) & (low[np.minimum(a + 1, len(low) - 1)] != data[np.minimum(a + 1, len(data) - 1)])


def _hashes(words: list[str], powers: Powers) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)]))
    return np.sort(word_hashes(raw, s, e, 71, powers))


def _kinds(data, low, a, b, begins, rows, filler, powers) -> np.ndarray:
    kind = np.zeros(len(a), np.int64)
    if not len(a):
        return kind
    digits, numeric = (np.concatenate(([0], np.cumsum(x[data]))) for x in (_DIGIT, _NUMERIC))
    sized = b - a
    number = (digits[b] > digits[a]) & (numeric[b] - numeric[a] == sized) & _DIGIT[data[np.minimum(a + (data[a] < 48), b - 1)]]
    upper = _upper(data, low, a)
    units = _hashes(UNITS, powers)
    after = np.zeros(len(a), bool)
    after[1:] = number[:-1] & (rows[1:] == rows[:-1])
    kind[upper & ~begins] = NAME
    kind[after & np.isin(filler, units)] = UNIT
    kind[number] = NUMBER
    return kind


def _windows(tokens: Tokens, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of every window: of its very words in small letters, and of its templates that
    have few enough placeholders: as its names are told, and with words that open a sentence as names."""
    words, at = window_hashes(tokens.filler, tokens.first, length, powers)
    hashes, places = [mix(words ^ _VERBATIM)], [at]
    opened = np.where(tokens.opener, NAME, tokens.kind)
    for kind in (tokens.kind, opened):
        canon, _ = window_hashes(np.where(kind == LITERAL, tokens.filler, _PLACE[kind]), tokens.first, length, powers)
        slots = np.concatenate(([0], np.cumsum(kind != LITERAL)))
        use = slots[at + length] - slots[at] <= length * MOST_SLOTS // WINDOW
        if kind is opened:
            new = np.concatenate(([0], np.cumsum(tokens.opener)))
            use &= new[at + length] > new[at]
        hashes.append(canon[use])
        places.append(at[use])
    return np.concatenate(hashes), np.concatenate(places)


def _item_windows(batches):
    powers = [Powers(72), Powers(73)]
    for batch in batches:
        for part in pieces(batch):
            tokens = Tokens(part.column("text"), powers[0])
            counts = np.diff(tokens.first)
            for length in np.unique(np.minimum(counts, WINDOW)).tolist():
                if length < 3:
                    continue
                hashes, at = _windows(tokens, length, powers[1])
                row = np.searchsorted(tokens.first, at, "right") - 1
                fits = counts[row] == length if length < WINDOW else counts[row] >= WINDOW
                hashes, at, row = hashes[fits], at[fits], row[fits]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), length), pa.int32()),
                    part.column("item").take(pa.array(row)), pa.array((at - tokens.first[row]).astype(np.int32)),
                    pa.array(counts[row].astype(np.int32))],
                    ["hash", "length", "item", "item_at", "item_size"])


def _text_windows(lengths: list[int]):
    """All windows of the texts as rows; the way for large benchmarks."""

    def run(batches):
        powers = [Powers(72), Powers(73)]
        for batch in batches:
            for part in pieces(batch):
                tokens = Tokens(part.column("text"), powers[0])
                for length in lengths:
                    hashes, at = _windows(tokens, length, powers[1])
                    row = np.searchsorted(tokens.first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([
                        part.column("print").take(pa.array(row)), pa.array((at - tokens.first[row]).astype(np.int32)),
                        pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), length), pa.int32())],
                        ["print", "at", "hash", "length"])

    return run


def _hits(index: dict[int, np.ndarray]):
    """Windows of the texts that some item has; the way for benchmarks that fit in memory."""

    def run(batches):
        powers = [Powers(72), Powers(73)]
        for batch in batches:
            for part in pieces(batch):
                tokens = Tokens(part.column("text"), powers[0])
                for length, known in index.items():
                    hashes, at = _windows(tokens, length, powers[1])
                    hashes = hashes.view(np.int64)
                    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    found = known[place] == hashes
                    hashes, at = hashes[found], at[found]
                    row = np.searchsorted(tokens.first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([
                        part.column("print").take(pa.array(row)), pa.array((at - tokens.first[row]).astype(np.int32)),
                        pa.array(hashes), pa.array(np.full(len(at), length), pa.int32())],
                        ["print", "at", "hash", "length"])

    return run


def consistent(item: Tokens, text: Tokens, i0: int, t0: int, cover: np.ndarray) -> np.ndarray:
    """The covered tokens of an alignment whose slots map one to one and keep their kinds.

    ``cover`` are the covered tokens of the item; token k of it lies over token t0 + k of the text. Names and
    units must all be consistent, else none is left. Numbers may coincide or fall apart in another version of
    an item, so the pairs of numbers that agree most often count, and the others are not covered.
    """
    i, t = i0 + cover, t0 + cover
    none = cover[:0]
    same, ik, tk = item.filler[i] == text.filler[t], item.kind[i], text.kind[t]
    # A name keeps its kind in small letters, and any word where a sentence opens in one of the two.
    alike = (ik == tk) & ((ik != LITERAL) | same) | same & ((ik == NAME) | item.begins[i] | text.begins[t])
    alike |= ((ik == NAME) | item.opener[i]) & ((tk == NAME) | text.opener[t])
    if not alike.all():
        return none
    slot = (ik != LITERAL) | ~same
    kinds = np.where(slot & (ik == LITERAL), NAME, ik)
    pairs = Counter(zip(kinds[slot].tolist(), item.filler[i][slot].tolist(), text.filler[t][slot].tolist()))
    there: dict = {}
    back: dict = {}
    for (kind, x, y), _ in pairs.most_common():
        if (kind, x) in there or (kind, y) in back:
            if kind != NUMBER:
                return none
            continue
        there[kind, x], back[kind, y] = y, x
    stays = [kind == LITERAL or there.get((kind, x)) == y for kind, x, y in zip(
        kinds.tolist(), item.filler[i].tolist(), text.filler[t].tolist())]
    return cover[np.array(stays, bool)]


def _checked(covered: float):
    """One row per alignment: covered share of the item, and whether it counts."""

    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        powers = Powers(72)
        starts = np.flatnonzero(first)
        texts = Tokens(table.column("text").combine_chunks().take(pa.array(starts)), powers)
        items = Tokens(table.column("item_text").combine_chunks().take(pa.array(starts)), powers)
        at, length = (table.column(c).to_numpy() for c in ("item_at", "length"))
        shift = table.column("shift").to_numpy()
        share, exact, good = [], [], []
        for k, (a, b) in enumerate(bounds(first)):
            size = int(items.first[k + 1] - items.first[k])
            mask = np.zeros(size, bool)
            for p, n in zip(at[a:b].tolist(), length[a:b].tolist()):
                mask[p:p + n] = True
            cover = np.flatnonzero(mask)
            i0, t0 = int(items.first[k]), int(texts.first[k] + shift[a])
            exact.append(bool((items.filler[i0 + cover] == texts.filler[t0 + cover]).all()))
            share.append(len(consistent(items, texts, i0, t0, cover)) / size)
            good.append(share[-1] >= covered)
        return pa.table({
            "print": table.column("print").take(pa.array(starts)), "item": table.column("item").take(pa.array(starts)),
            "share": share, "exact": exact, "good": good})

    return gathered(compute, ("print", "item", "shift"), 8 << 20)


def _marked(docs: DataFrame, benchmark: DataFrame, covered: float, lookup_windows: int) -> tuple[DataFrame, int]:
    """(print, item_id, share, exact): alignments that count, by fingerprint of the text; their number."""
    items = pick(benchmark, "item_id", "text").where(F.col("text").isNotNull()).groupBy("text").agg(
        F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("text"))
    shape = "hash BIGINT, length INT, item BIGINT, item_at INT, item_size INT"
    keys, seen = stored(items.select("item", "text").mapInArrow(_item_windows, shape), "item_windows",
                        lengths=F.collect_set("length"))
    lengths = sorted(seen["lengths"] or [])
    texts = pick(docs, "doc_id", "text").where(F.col("text").isNotNull()).select(
        F.xxhash64("text").alias("print"), "text")
    found = "print BIGINT, at INT, hash BIGINT, length INT"
    if seen["rows"] <= lookup_windows:
        rows = keys.select("length", "hash").distinct().toArrow()
        index = {n: np.sort(rows.filter(pc.equal(rows.column("length"), n)).column("hash").to_numpy())
                 for n in lengths}
        hits = texts.mapInArrow(_hits(index), found)
    else:
        known = keys.select("hash", "length").distinct()
        hits = texts.mapInArrow(_text_windows(lengths), found).join(known, ["hash", "length"], "left_semi")
    # Equal texts have equal windows; each counts once.
    hits, _ = stored(hits.distinct(), "hits")
    aligned = hits.join(small(keys, seen["rows"]), ["hash", "length"]).select(
        "print", "item", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "length", "item_size")
    # Windows of one alignment are no more than the item has. What covers too little is dropped
    # before any text is fetched.
    whole = aligned.groupBy("print", "item", "shift").agg(
        F.collect_set(F.struct("item_at", "length")).alias("windows"), F.max("item_size").alias("size"))
    reach = F.aggregate("windows", F.lit(0), lambda n, w: n + w["length"])
    whole, least = stored(whole.where(reach >= F.col("size") * covered), "aligned")
    wanted = small(whole.select("print").distinct(), least["rows"])
    fetched = texts.join(wanted, "print", "left_semi").groupBy("print").agg(F.first("text").alias("text"))
    both = whole.join(fetched, "print").join(items.select("item", F.col("text").alias("item_text")), "item").select(
        "print", "item", "shift", "text", "item_text", F.explode("windows").alias("w")).select(
        "print", "item", "shift", "text", "item_text", "w.item_at", "w.length")
    checked = (
        both.repartition("print", "item").sortWithinPartitions("print", "item", "shift")
        .mapInArrow(_checked(covered), "print BIGINT, item BIGINT, share DOUBLE, exact BOOLEAN, good BOOLEAN"))
    marked, found = stored(
        checked.where("good").groupBy("print", "item").agg(F.max(F.struct("share", "exact")).alias("best"))
        .join(items.select("item", "item_id"), "item").groupBy("print").agg(
            F.count(F.lit(1)).alias("n_items"), F.max(F.struct(
                "best.share", "best.exact", (-F.coalesce("item_id", F.lit(0))).alias("order"), "item_id")).alias("top"))
        .select("print", "n_items", "top.item_id", "top.share", "top.exact"), "marked")
    return marked, found["rows"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED,
                       lookup_windows: int = LOOKUP_WINDOWS) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, share and exact for every row of ``docs`` (doc_id, text).

    ``benchmark`` has item_id and text. n_items counts the different item texts that the text holds, verbatim
    or re-parameterised; item_id, share (of the item's tokens) and exact (no filler differs) describe the one
    covered most, ties to the smaller item_id. Null and empty texts hold none and null, empty or shorter than
    three tokens items match nothing. Items of equal text count once, with their least item_id. Repeated rows
    are all marked. Other columns are ignored; empty tables give no matches.
    """
    marked, rows = _marked(docs, benchmark, covered, lookup_windows)
    return pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("print")).join(
        small(marked, rows), "print", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id", "share", F.coalesce("exact", F.lit(False)).alias("exact"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no benchmark item."""
    marked, rows = _marked(docs, benchmark, covered, LOOKUP_WINDOWS)
    gone = small(marked.select(F.col("print").alias("_print")), rows)
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["_print"], "left_anti")
