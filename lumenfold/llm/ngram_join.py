"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share or more.

Exact: texts with equal sets fold into one set first; two different sets that reach the threshold
must share a shingle among the first n - ceil(t n) + 1 of either in any common order, so sets meet
in the lists of those. The order puts common shingles last, by a sketch of fixed size that every
document has counted into. Lists are dealt out as tiles by band of set size. Hashed bitmaps bound the
overlap of every pair from above; what passes is settled by intersecting the sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, materialize

SKETCH_BITS, CHUNK = 18, 4096
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WordHashes(dict):
    """64-bit hashes of words, kept while there are fewer than `most`."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: WordHashes, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of `size` words.

    A-Z is lower-cased, words are runs without ASCII white space; with fewer words the whole
    sequence is one shingle; without words the set is empty. A shingle is known by its 64-bit
    hash: within one pair of texts a false match has a chance of about 1 in 10^11 at most.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(size, len(codes))
    count = len(codes) - width + 1
    with np.errstate(over="ignore"):
        out = codes[:count] + np.uint64(width)
        for k in range(1, width):
            out = (out * _MUL) ^ (out >> np.uint64(29))
            out += codes[k : count + k]
        out = (out ^ (out >> np.uint64(30))) * _MIX
        out ^= out >> np.uint64(27)
    return np.unique(out)


def bitmap(tokens: np.ndarray) -> bytes:
    """A hashed bitmap of eight bits a token or more, a power of two wide, 64 bits at least."""
    bits = max(64, 1 << int(np.ceil(np.log2(8 * len(tokens)))))
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens >> np.uint64(7)) & np.uint64(bits - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def fold(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of several widths as rows of `size` bytes: wider ones are folded by OR."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, dtype=np.uint8).reshape(-1, size), axis=0) for m in maps])


def most_common(n: int, m: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The most that a set of n can share with sets of m: a bit that one bitmap lacks is a shingle of the other's own."""
    return np.minimum(n - _POP[mine & ~theirs].sum(axis=1, dtype=np.int64), m - _POP[theirs & ~mine].sum(axis=1, dtype=np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def fingerprint(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def _sets_and_sketch(size: int):
    """Per document its set's size, fingerprint and bitmap; per task the counts of all shingles by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, task = WordHashes(), np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                tokens = shingle_set(text, words, size)
                np.add.at(counts, (tokens & np.uint64(len(counts) - 1)).astype(np.int64), 1)
                rows.append((len(tokens), fingerprint(tokens), bitmap(tokens)) if len(tokens) else (0, None, None))
                task = task or rows[-1][1] or 0
            n, sids, bits = zip(*rows) if rows else ((), (), ())
            none = pd.array([None] * len(n), dtype="Int64")
            yield pd.DataFrame({"_id": batch["_id"].astype("Int64"), "n": n, "sid": pd.array(sids, dtype="Int64"), "bits": bits, "chunk": none.astype("Int32"), "salt": none, "counts": None})
        chunks = counts.reshape(-1, CHUNK)
        none = pd.array([None] * len(chunks), dtype="Int64")
        yield pd.DataFrame({"_id": none, "n": -1, "sid": none, "bits": None, "chunk": pd.array(range(len(chunks)), dtype="Int32"), "salt": task, "counts": [c.astype("<i8").tobytes() for c in chunks]})

    return run


def _add_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum the count chunks of a partition while they stream by; memory is one sketch at most."""
    total, salt = {}, 0
    for batch in batches:
        for chunk, counts, salt in zip(batch["chunk"], batch["counts"], batch["salt"]):
            more = np.frombuffer(counts, dtype="<i8")
            total[chunk] = total[chunk] + more if chunk in total else more
    yield pd.DataFrame({"chunk": list(total), "salt": salt, "counts": [c.astype("<i8").tobytes() for c in total.values()]})


def _summed(chunks: DataFrame) -> np.ndarray:
    """The counts of all tasks: groups of tasks add up theirs first, then 16 tasks add up the groups'."""
    shape = "chunk int, salt long, counts binary"
    tasks = chunks.filter("chunk = 0").count()
    some = chunks.repartition(max(16, tasks // 16), "salt").mapInPandas(_add_chunks, shape)
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    # 2^18 counters in 64 chunks, however large the corpus is
    for row in some.repartition(16, "chunk").mapInPandas(_add_chunks, shape).collect():
        counts[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] += np.frombuffer(row["counts"], dtype="<i8")
    return counts


def _prefixes(size: int, percent: int, sketch, most_seen: int = 200_000):
    """Sets and their prefixes; a set that a task has just seen isn't sent again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, seen = WordHashes(), sketch.value, set()
        for batch in batches:
            sids, prefixes = [], []
            for text in batch["_text"]:
                tokens = shingle_set(text, words, size)
                if not len(tokens) or (sid := fingerprint(tokens)) in seen:
                    continue
                if len(seen) >= most_seen:
                    seen.clear()
                seen.add(sid)
                keep = prefix_length(len(tokens), percent)
                order = np.lexsort((tokens, counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]))
                sids.append(sid)
                prefixes.append(tokens[order[:keep]].view(np.int64))
            yield pd.DataFrame({"sid": pd.Series(sids, dtype="int64"), "prefix": pd.Series(prefixes, dtype=object)})

    return run


def _bounded(percent: int):
    """Pairs that their sizes and bitmaps allow to link, with the bound of their overlap in parts of the union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bound = np.zeros(len(batch))
            for k, (n, m, x, y) in enumerate(zip(batch["na"], batch["nb"], batch["x"], batch["y"])):
                width = min(len(x), len(y))
                most = int(most_common(n, m, fold([x], width), fold([y], width))[0])
                bound[k] = most / (n + m - most) if 100 * most >= percent * (n + m - most) else -1
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "bound": bound})[bound >= 0]

    return run


def _settle(size: int, percent: int):
    """Exact test of stars: a hub's set stands before those of its spokes and is intersected with each.

    Rows come sorted by hub and salt, the hub itself first. A text counts only if it has the set that was meant.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, at, hub = WordHashes(), None, None
        for batch in batches:
            out = []
            for a, salt, sid, text in zip(batch["a"], batch["salt"], batch["sid"], batch["_text"]):
                if at != (a, salt):
                    at, hub = (a, salt), None
                tokens = shingle_set(text, words, size)
                if not len(tokens) or fingerprint(tokens) != sid:
                    continue
                if sid == a:
                    hub = tokens
                elif hub is not None:
                    x, y = (tokens, hub) if len(tokens) < len(hub) else (hub, tokens)
                    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * same >= percent * (len(x) + len(y) - same):
                        out.append((a, sid))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def narrowed(bits: int, wide: int, width: int) -> int:
    """A bitmap of `wide` bits, held as a number, folded by OR to `width` bits."""
    while wide > width:
        wide //= 2
        bits = (bits >> wide) | (bits & ((1 << wide) - 1))
    return bits


def _tile_pairs(percent: int, most_seen: int = 500_000):
    """Pairs of a tile that the bitmaps can't rule out. Rows come sorted by token, band and tile; a pair
    that a task has just compared in another tile isn't compared again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tile, seen = None, [], set()

        def meet(rows: list) -> list[tuple[int, int]]:
            found, rows = [], sorted({r[0]: r for r in rows}.values(), key=lambda r: r[1])
            maps = [int.from_bytes(r[5], "little") for r in rows]
            for i, (sid, n, comp, side, guest, bits) in enumerate(rows):
                width = 8 * len(bits)
                for j in range(i + 1, len(rows)):
                    other = rows[j]
                    if other[1] * percent > n * 100:
                        break
                    if other[2] == comp or (side != 2 and other[3] == side) or (guest and other[4]):
                        continue
                    pair = (sid, other[0]) if sid < other[0] else (other[0], sid)
                    if pair in seen:
                        continue
                    if len(seen) >= most_seen:
                        seen.clear()
                    seen.add(pair)
                    theirs = narrowed(maps[j], 8 * len(other[5]), width)
                    most = min(n - (maps[i] & ~theirs).bit_count(), other[1] - (theirs & ~maps[i]).bit_count())
                    if 100 * most >= percent * (n + other[1] - most):
                        found.append(pair)
            return found

        for batch in batches:
            out = []
            for token, band, part, *row in zip(*(batch[c].tolist() for c in ("token", "band", "tile", "sid", "n", "comp", "side", "guest", "bits"))):
                if at != (token, band, part):
                    out += meet(tile)
                    at, tile = (token, band, part), []
                tile.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(meet(tile), columns=["a", "b"], dtype="int64")

    return run


def _own() -> list:
    """An id as two columns without nulls, so that null ids meet in plain joins."""
    return [F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).alias("_own")]


def _verified(pairs: DataFrame, named: DataFrame, texts: DataFrame, size: int, percent: int, spokes: int = 1000) -> DataFrame:
    """The pairs that link. A pair's smaller end is a hub; its spokes travel to it once each, as texts,
    which are shorter than arrays of hashes. A hub of many spokes has several salts and stands by each."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / spokes).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", F.col("b").alias("sid"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    hubs = many.select("a", F.col("a").alias("sid"), F.explode(F.expr("sequence(0, parts - 1)")).alias("salt"))
    asked = materialize(dealt.unionByName(hubs).join(named.select("sid", F.col("lowest").alias("_id")), "sid").select(*_own(), "a", "salt", "sid"))
    # texts are shuffled by id, at every size alike
    rows = texts.select(*_own(), "_text").join(asked.hint("merge"), ["_none", "_own"]).select("a", "salt", "sid", "_text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("sid") != F.col("a"), "sid")
    return materialize(rows.mapInPandas(_settle(size, percent), "a long, b long").distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, tile_rows: int = 512) -> DataFrame:
    """Per row of docs: id_col, n_shingles and component_id.

    Two rows link when 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest id among the rows reachable by links. A row without words (null, empty or
    blank text) has an empty set and stays alone: its component is its own id. Rows that repeat
    an id are rows of their own. A null id never names a component unless all of it are null.
    An empty table gives an empty result; other columns are ignored.

    Links inside a group that is already connected aren't needed, so each set first meets the one
    of its lists' pivots that it may be nearest to; then all pairs of a list across the
    components that remain meet in tiles: by band of set size, a set standing in its own band and as
    a guest in the next, and beyond tile_rows by hash. None that could join two components is missed.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    first = materialize(texts.mapInPandas(_sets_and_sketch(size), "_id long, n long, sid long, bits binary, chunk int, salt long, counts binary"))
    sets = first.filter("chunk is null").select("_id", "n", "sid")
    sketch = spark.sparkContext.broadcast(_summed(first.filter("chunk is not null").select("chunk", "salt", "counts")))
    named = first.filter("sid is not null").groupBy("sid").agg(F.min("_id").alias("lowest"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    named = materialize(named)

    # A set is in a list once for each task at most, so a list's share of all rows is that of its
    # sets divided by the length of their prefixes: no list is hot even if one text fills the corpus.
    prefixes = texts.mapInPandas(_prefixes(size, percent, sketch), "sid long, prefix array<long>")
    rows = prefixes.select("sid", F.explode("prefix").alias("token"))
    by_token = Window.partitionBy("token").orderBy("sid")
    marked = rows.withColumn("before", F.lag("sid").over(by_token)).withColumn("after", F.lead("sid").over(by_token)).withColumn("pivot", F.first("sid").over(by_token))
    lists = marked.filter("pivot <> sid or after is not null").filter("before is null or before <> sid")
    lists = materialize(lists.select("token", "sid"))
    # A list's pivot is the set that is in most lists: what others were copied from shares more with each than they do
    shared = lists.groupBy("sid").agg(F.count("*").alias("lists"))
    central = lists.join(shared, "sid").groupBy("token").agg(F.max(F.struct("lists", "sid"))["sid"].alias("pivot"))

    def ends_of(pairs: DataFrame) -> DataFrame:
        x, y = (named.select(F.col("sid").alias(e), F.col("n").alias("n" + e), F.col("bits").alias(v)) for e, v in (("a", "x"), ("b", "y")))
        fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        return pairs.join(y, "b").join(x, "a").filter(fits).select("a", "b", "na", "nb", "x", "y")

    pairs = lists.join(central, "token").filter("pivot <> sid").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    may = ends_of(pairs).mapInPandas(_bounded(percent), "a long, b long, bound double")
    nearest = materialize(may.groupBy("b").agg(F.max(F.struct("bound", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"))
    links = _verified(nearest, named, texts, size, percent)
    once = materialize(connected_components(links, "a", "b").select(F.col("node").alias("sid"), F.col("component").alias("comp")))

    labelled = lists.select("token", "sid").join(once, "sid", "left").select("token", "sid", F.coalesce("comp", "sid").alias("comp"))
    open_lists = (
        labelled.groupBy("token")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.hash("sid").cast("long")).alias("s"))
        .filter("lo <> hi").groupBy("size", "x", "s").agg(F.min("token").alias("token"))  # lists of the same sets are one
    )
    # sets that may link are at most one band apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / percent) * (1 + 1e-6))).cast("int")
    members = labelled.join(open_lists.select("token"), "token").join(named.select("sid", "n"), "sid")
    members = members.withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", band + F.col("guest").cast("int"))
    members = materialize(members.select("token", "band", "sid", "comp", "guest"))
    open_bands = (
        members.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.bool_and("guest").alias("guests"))
        .filter("lo <> hi and not guests").select("token", "band", "lo", F.ceil(F.col("size") / (tile_rows // 2)).cast("int").alias("blocks"))
    )
    tiles = (
        members.join(open_bands, ["token", "band"])
        .withColumn("own", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("token", "band", "lo", "sid", "comp", "guest", (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("tile"),
                F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        .join(named.select("sid", "n", "bits"), "sid")
    )
    # lists of one family begin with one component and go to the same few tasks, where their pairs fold
    tiles = tiles.repartition("lo", F.pmod(F.xxhash64("token", "tile"), F.lit(4))).sortWithinPartitions("token", "band", "tile")
    more = tiles.select("token", "band", "tile", "sid", "comp", "guest", "side", "n", "bits").mapInPandas(_tile_pairs(percent), "a long, b long").distinct()
    late = _verified(materialize(more), named, texts, size, percent)
    late = late.join(once.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), "a", "left").join(once.select(F.col("sid").alias("b"), F.col("comp").alias("cb")), "b", "left")
    twice = connected_components(late.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b").select(F.col("node").alias("comp"), F.col("component").alias("final"))
    ends = named.select("sid", "lowest").join(once, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")).join(twice, "comp", "left").select("sid", "lowest", F.coalesce("final", "comp").alias("comp"))
    ends = materialize(ends)
    lowest = ends.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    final = ends.join(lowest, "comp").select("sid", "component_id")
    return sets.join(final, "sid", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id")
    )
