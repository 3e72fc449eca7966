"""Benchmark decontamination by template canonicalisation, alignment and slot consistency.

Short windows of tokens, as written and as templates, find where an item may stand in a document;
there the whole item is aligned by edit distance over tokens, and its slots must be consistent.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Unit words that follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros usd eur degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules newton newtons".split()
)
WORD, NAME, NUMBER, UNIT, END = range(5)
_TOKEN = re.compile(r"[.!?\n]|\d+(?:[.,]\d+)*|[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.array([0, 0x4E414D45, 0x4E554D42, 0x554E4954], dtype=np.uint64)


class Tokens(dict):
    """The number of a token by its spelling, and by number its hash and kind. All go before a text once there are `most`."""

    most = 300_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.kinds = array("Q"), array("b")

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and kinds of a text's tokens."""
        if len(self) >= self.most:
            self.clear()
            self.hashes, self.kinds = array("Q"), array("b")
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if not len(at):
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int8)
        return np.frombuffer(self.hashes, dtype=np.uint64)[at], np.frombuffer(self.kinds, dtype=np.int8)[at]

    def __missing__(self, token: str) -> int:
        lower = token.lower()
        kind = END if token in ".!?\n" else NUMBER if token[0].isdigit() else UNIT if lower in UNITS else NAME if token[0].isupper() and token[1:].islower() else WORD
        self.hashes.append(xxhash.xxh64_intdigest(lower.encode("utf-8", "surrogatepass")))
        self.kinds.append(kind)
        number = self[token] = len(self)
        return number


def template(text: str | None, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template codes, kinds, values and shapes of a text's tokens.

    Numbers become <number>, a unit after a number <unit>, a capitalised word inside a sentence
    <name>; every other token stands for itself, in lower case. Values are hashes of the tokens.
    Shapes are kinds, with capitalised words at the start of a sentence as <name> too.
    """
    value, kind = tokens.of(_TOKEN.findall(text) if text else [])
    before = np.empty_like(kind)
    before[:1], before[1:] = END, kind[:-1]
    shape = np.where((kind == UNIT) & (before != NUMBER), WORD, kind)
    kind = np.where((shape == NAME) & (before == END), WORD, shape)
    keep = kind != END
    value, kind, shape = value[keep], kind[keep], shape[keep]
    return np.where(kind == WORD, value, _SLOT[kind]), kind.astype(np.int8, copy=False), value, shape.astype(np.int8, copy=False)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    count = len(codes) - width + 1
    if count < 1:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(count, width, dtype=np.uint64)
        for k in range(width):
            out ^= out >> np.uint64(29)
            out *= _MUL
            out += codes[k : count + k]
    return out


def _windows(kind: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows of which at least half are words."""
    words = np.r_[0, np.cumsum(kind == WORD)]
    return np.flatnonzero(2 * (words[width:] - words[:-width]) >= width)


def seed_width(n: int) -> int:
    """Tokens of the windows that find an item of n: 15 tokens or more keep 4 in a row after any two edits, 11 keep 3."""
    return 4 if n >= 15 else min(n, 3)


def item_windows(codes: np.ndarray, kind: np.ndarray, value: np.ndarray, shape: np.ndarray) -> set[tuple[int, int]]:
    """(start, hash) of an item's windows: all as written, and as templates those of at least half
    words; a capitalised first token, which is a word or a name by where it is quoted, in both readings."""
    w = seed_width(len(codes))
    out = set(enumerate(window_hashes(value, w).view(np.int64).tolist()))
    if len(codes) < 4:
        return out
    readings = [(codes, kind)]
    if shape[0] == NAME:
        readings.append((np.r_[_SLOT[NAME], codes[1:]], np.r_[np.int8(NAME), kind[1:]]))
    for c, k in readings:
        hashes = window_hashes(c, w).view(np.int64)
        out |= {(int(i), int(hashes[i])) for i in _windows(k, w)}
    return out


def align(item: tuple, doc: tuple, shifts: np.ndarray, coverage: float, consistency: float) -> tuple[float, float, bool] | None:
    """The best placing of an item near some shifts in a document: share of its tokens that align
    (1 - edits / tokens), consistency of its slots, and whether it stands there as written. None
    if no placing reaches coverage and consistency. Tokens align if they are equal but for case,
    or if both are names, numbers or units where the item has a slot.
    """
    _, kind, value, shape = item
    _, _, found, looks = doc
    n, best = len(value), None
    slot = np.where((kind == WORD) & ~((np.arange(n) == 0) & (shape == NAME)), -1, shape)
    pad = int(n * (1 - coverage)) + 1
    shifts = np.unique(shifts)
    for near in np.split(shifts, np.flatnonzero(np.diff(shifts) > 2 * pad) + 1):
        lo, hi = max(0, int(near[0]) - pad), int(near[-1]) + n + pad
        b, looks_b = found[lo:hi], looks[lo:hi]
        if (np.isin(value, b) | np.isin(slot, looks_b)).sum() < coverage * n:
            continue
        # rows: tokens of the item; a placing starts and ends anywhere in the region
        steps = np.arange(len(b) + 1)
        table = np.zeros((n + 1, len(b) + 1))
        for i in range(n):
            cost = np.where(b == value[i], 0.0, np.where(looks_b == slot[i], 1e-6, 1.0))
            row = np.r_[i + 1.0, np.minimum(table[i, :-1] + cost, table[i, 1:] + 1)]
            table[i + 1] = np.minimum.accumulate(row - steps) + steps
        ends = np.flatnonzero(np.floor(table[n] + 1e-9) <= n * (1 - coverage) + 1e-9)
        ends = ends[np.argsort(table[n, ends], kind="stable")]
        while len(ends):
            i, j, met, same = n, int(ends[0]), [], 0
            while i:
                equal = j and b[j - 1] == value[i - 1]
                paired = j and (equal or looks_b[j - 1] == slot[i - 1])
                if j and abs(table[i, j] - table[i - 1, j - 1] - (0.0 if equal else 1e-6 if paired else 1.0)) < 1e-8:
                    i, j = i - 1, j - 1
                    same += bool(equal)
                    if paired and slot[i] >= 0:
                        met.append((int(slot[i]), int(value[i]), int(b[j])))
                elif abs(table[i, j] - table[i - 1, j] - 1) < 1e-8:
                    i -= 1
                else:
                    j -= 1
            mostly: dict = {}
            for (s, x, _), times in Counter(met).items():
                mostly[s, x] = max(mostly.get((s, x), 0), times)
            consistent = sum(mostly.values()) / len(met) if met else 1.0
            cost = float(table[n, ends[0]])
            if consistent >= consistency:
                this = (1 - float(np.floor(cost + 1e-9)) / n, consistent, same == n and cost < 1e-9)
                best = this if best is None else max(best, this)
                break  # those behind it in this region cover no more
            ends = ends[np.abs(ends - ends[0]) > max(1, n // 2)]
    return best


def _bench_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens = Tokens()
    for batch in batches:
        out = []
        for item, text in zip(batch["_item"], batch["_text"]):
            parts = template(text, tokens)
            if len(parts[0]):
                out += [(item, text, seed_width(len(parts[0])), at, h) for at, h in item_windows(*parts)]
        yield pd.DataFrame(out, columns=["item", "words", "width", "at", "hash"])


def _doc_windows(parts: tuple, width: int) -> list[np.ndarray]:
    """Window hashes of a document by start: as a template and as written."""
    return [window_hashes(parts[0], width).view(np.int64), window_hashes(parts[2], width).view(np.int64)]


#: Bits of a window's hash that tell most windows of documents from all of the items'.
_FIRST = 20


def _first(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - _FIRST)).view(np.int64)


def _aligned_docs(known, items, coverage: float, consistency: float):
    """Documents against all items: known holds sorted hashes, items and starts by width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, by_width = Tokens(), known.value
        parsed = {i: template(t, tokens) for i, t in items.value.items()}
        firsts = {w: np.zeros(1 << _FIRST, dtype=bool) for w in by_width}
        for w, (table, _, _) in by_width.items():
            firsts[w][_first(table)] = True
        for batch in batches:
            out = []
            for doc, text in zip(batch["_id"], batch["_text"]):
                parts, hits = template(text, tokens), []
                for w, (table, item, at) in by_width.items():
                    for hashes in _doc_windows(parts, w):
                        pos = np.flatnonzero(firsts[w][_first(hashes)])
                        lo = np.searchsorted(table, hashes[pos])
                        met = table[np.minimum(lo, len(table) - 1)] == hashes[pos]
                        pos, lo = pos[met], lo[met]
                        if len(pos):
                            count = np.searchsorted(table, hashes[pos], side="right") - lo
                            rows = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                            hits.append(np.stack([item[rows], np.repeat(pos, count) - at[rows], at[rows]]))
                if not hits:
                    continue
                found = np.concatenate(hits, axis=1)
                found = found[:, np.argsort(found[0], kind="stable")]
                for group in np.split(found, np.flatnonzero(np.diff(found[0])) + 1, axis=1):
                    got = align(parsed[int(group[0, 0])], parts, group[1], coverage, consistency)
                    if got:
                        out.append((doc, int(group[0, 0]), len(np.unique(group[2])), *got))
            frame = pd.DataFrame(out, columns=["doc", "item", "windows", "covered", "consistent", "verbatim"])
            frame["doc"] = frame["doc"].astype("Int64")
            yield frame

    return run


def _all_windows(widths: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            for row, text in zip(batch["_row"], batch["_text"]):
                parts = template(text, tokens)
                every = [(w, h) for w in widths for h in _doc_windows(parts, w)]
                yield pd.concat([pd.DataFrame({"row": row, "width": w, "pos": np.arange(len(h)), "hash": h}) for w, h in every])

    return run


def _aligned_pairs(coverage: float, consistency: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            out = []
            for doc, text, item, words, windows, shifts in zip(*(batch[c] for c in ("_id", "_text", "item", "words", "windows", "shifts"))):
                got = align(template(words, tokens), template(text, tokens), np.asarray(shifts), coverage, consistency)
                if got:
                    out.append((doc, item, windows, *got))
            frame = pd.DataFrame(out, columns=["doc", "item", "windows", "covered", "consistent", "verbatim"])
            frame["doc"] = frame["doc"].astype("Int64")
            yield frame

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    coverage: float = 0.5, consistency: float = 0.8, max_windows: int = 2_000_000,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, as written or re-parameterised.

    Windows of 4 tokens (items under 15 tokens: 3, or all they have) join on their hash, as written
    for every item, and as templates unless they are mostly placeholders. Where one is found, the
    item is aligned with the document by edit distance over tokens. A pair stays if at least
    `coverage` of the item's tokens align in one placing and its slots are consistent there: the
    share of slot occurrences whose item value meets the document value it mostly meets is at
    least `consistency`. Items of fewer than four tokens are found as written only.
    Returns id_col, item_col, windows, covered, consistent, verbatim. Null texts are empty, empty
    texts and empty tables match nothing, null ids are matched like others, and rows that repeat
    an id count as one document, by its best placing.

    Windows and items of the benchmark are broadcast if there are at most max_windows windows,
    which leaves nothing but pairs to shuffle; beyond that all windows of all documents are shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text).alias("_text")).filter("_item is not null")
    windows = materialize(items.mapInPandas(_bench_rows, "item long, words string, width int, at int, hash long"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    result = "doc long, item long, windows long, covered double, consistent double, verbatim boolean"
    one_each = windows.select("item").distinct().count() == windows.select("item", "words").distinct().count()
    if one_each and windows.limit(max_windows + 1).count() <= max_windows:
        found = windows.select("width", "hash", "item", "at").distinct().toPandas().sort_values("hash")
        known = {int(w): tuple(part[c].to_numpy(np.int64) for c in ("hash", "item", "at")) for w, part in found.groupby("width")}
        words = {r["item"]: r["words"] for r in windows.select("item", "words").distinct().collect()}
        pairs = texts.mapInPandas(_aligned_docs(spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(words), coverage, consistency), result)
    else:
        # a row is known by two hashes of its id and text; equal rows fold
        keyed = materialize(texts.select(F.concat_ws(":", F.xxhash64("_id", "_text"), F.xxhash64(F.lit(1), "_id", "_text")).alias("_row"), "_id", "_text").dropDuplicates(["_row"]))
        widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
        hits = keyed.select("_row", "_text").mapInPandas(_all_windows(widths), "row string, width int, pos int, hash long").join(windows, ["width", "hash"])
        hits = hits.groupBy("row", "item", "words").agg(F.count_distinct("at").alias("windows"), F.collect_set(F.col("pos") - F.col("at")).alias("shifts"))
        pairs = hits.join(keyed, F.col("row") == F.col("_row")).select("_id", "_text", "item", "words", "windows", "shifts").mapInPandas(_aligned_pairs(coverage, consistency), result)
    best = materialize(pairs).groupBy("doc", "item").agg(F.max(F.struct("covered", "consistent", "verbatim", "windows")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.windows", "b.covered", "b.consistent", "b.verbatim")
