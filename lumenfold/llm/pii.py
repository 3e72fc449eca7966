"""PII: base patterns, and bootstrapped contextual extraction on top. DataFrame functions only.

Base matches seed a graph between lexical patterns (kind and the two words before a span) and
instances (the text of a span). Spark scores both sides in turn; patterns of high confidence disclose
further identifiers, spans of a loose shape that escape the base patterns, and those induce further
patterns wherever else they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive quantifiers where what follows can't match what was taken
#: (same matches, no backtracking over long runs), and a start that skips the inside of runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Loose identifier shapes outside the base patterns: a token of seven digits or more with
#: separators, or a token with an at sign or its spelt-out form in brackets.
LOOSE = r"(?<![A-Za-z0-9@])(?:\(?[0-9](?:[ ().-]?[0-9]){6,}+|[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9.-]++)(?![A-Za-z0-9@])"
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def match_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: an array of (start, end, value), in code points.

    Matches are bracketed by control characters and the text is split there: the odd parts are
    matches, and the lengths of the parts before give their places. The text must not hold
    those characters; no pattern here matches them, so `clean` swaps them for another one.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, start, step)["found"]


def clean(text: Column) -> Column:
    swapped = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)
    return F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), swapped).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    places = F.transform(F.reverse(F.split(digits, "", -1)), doubled)
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def part(p: Column) -> Column:
            p = F.regexp_replace(p, "^0+(?=.)", "")
            return (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(999)) <= 255)

        return F.forall(F.split(value, r"\.", -1), part)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base matches that pass their checks: an array of (start, rank, end, value), sorted."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")

    def of(kind: str) -> Column:
        spans = F.filter(match_spans(text, BASE[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else F.rlike(text, F.lit("[0-9][ 0-9-]{12,}"))
        return F.when(hint, spans).otherwise(none)

    return F.array_sort(F.concat(*[of(k) for k in KINDS]))


def count_kind(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    rank = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(text: Column, start: Column) -> Column:
    """The two words before a place, in lower case; null if there are fewer. Looks back only as far as it takes to see both whole."""
    def words(reach: Column) -> Column:
        before = F.substring(text, F.greatest(start - reach + 1, F.lit(1)), F.least(start, reach))
        return F.filter(F.split(F.lower(before), r"[^\p{L}]+", -1), lambda w: w != "")

    def last_two(seen: Column) -> Column:
        return F.when(F.size(seen) >= 2, F.array_join(F.slice(seen, -2, 2), " "))

    # a third word, which may be cut, shows that the last two are whole
    near, far = words(F.lit(40)), words(F.lit(400))
    return F.when((start <= 40) | (F.size(near) >= 3), last_two(near)).when((start <= 400) | (F.size(far) >= 3), last_two(far)).otherwise(last_two(words(start)))


def learned_spans(found: DataFrame, least_support: int, least_confidence: float, rounds: int) -> DataFrame:
    """Spans that confident patterns add: the row key, start, rank and end.

    A pattern counts for a kind where it has least_support different identifiers of that kind, seeds
    or found ones with a belief of least_confidence or more; its confidence is the mean belief in
    all its instances. The belief in a seed is 1 for its kind and 0 for others, that in another
    instance is the confidence of the best of its patterns. Both are updated `rounds` times, so
    identifiers found in one round induce patterns in the next. Of kinds that are believed alike
    the first of KINDS is taken.
    """
    seeds = found.select(F.explode("base").alias("s"), "clean").select("s.rank", "s.value", _context(F.col("clean"), F.col("s.start")).alias("pattern")).filter("pattern is not null")
    loose = found.select("_id", "mark", "clean", F.explode("loose").alias("s")).select("_id", "mark", "s.start", "s.end", "s.value", _context(F.col("clean"), F.col("s.start")).alias("pattern")).filter("pattern is not null")
    loose, seeds = materialize(loose), seeds.groupBy("rank", "value", "pattern").agg(F.count("*").alias("times"))
    by_kind = materialize(seeds.groupBy("rank", "pattern").agg(F.count("*").alias("seeds")))
    edges = materialize(loose.groupBy("pattern", "value").agg(F.count("*").alias("times")))
    sizes = by_kind.select("pattern", F.col("seeds").alias("n")).unionByName(edges.select("pattern", F.lit(1).cast("long").alias("n"))).groupBy("pattern").agg(F.sum("n").alias("all"))
    sizes = materialize(sizes)
    believed = None
    for _ in range(rounds):
        known = by_kind.select("rank", "pattern", F.col("seeds").cast("double").alias("belief"), "seeds")
        if believed is not None:
            more = believed.join(edges, "value").select("rank", "pattern", "belief", (F.col("belief") >= least_confidence).cast("long").alias("seeds"))
            known = known.unionByName(more).groupBy("rank", "pattern").agg(F.sum("belief").alias("belief"), F.sum("seeds").alias("seeds"))
        patterns = known.filter(F.col("seeds") >= least_support).join(sizes, "pattern").select("rank", "pattern", (F.col("belief") / F.col("all")).alias("confidence"))
        believed = materialize(patterns.join(edges, "pattern").groupBy("rank", "value").agg(F.max("confidence").alias("belief")))
    sure = believed.filter(F.col("belief") >= least_confidence).groupBy("value").agg(F.max_by("rank", F.struct("belief", -F.col("rank"))).alias("rank"))
    return loose.join(sure, "value").select("_id", "mark", "start", "rank", "end").distinct()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_support: int = 5, least_confidence: float = 0.5, rounds: int = 4) -> DataFrame:
    """Per row of docs: id_col, base and spans, arrays of (start, rank, end) in code points.

    rank is the place of the kind in KINDS. base holds what the base patterns find in the whole
    text, leftmost and non-overlapping per kind; spans adds what confident contexts disclose and
    no base span overlaps. Null and empty texts have none; an empty table gives an empty result;
    rows that repeat an id are rows of their own. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_text").alias("mark"), clean(F.col("_text")).alias("clean"))
    may = F.rlike("clean", F.lit(r"@|[0-9][ ().0-9-]{5,}[0-9]|\[at\]|\(at\)"))
    with_base = rows.withColumn("may", may).withColumn("base", F.when(F.col("may"), base_spans(F.col("clean"))))
    with_loose = with_base.withColumn("loose", F.when(F.col("may"), match_spans(F.col("clean"), LOOSE)))
    free = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    # one read of the texts; of those without any span only the key goes on
    found = materialize(with_loose.select("_id", "mark", "base", free.alias("loose"), F.when((F.size("base") > 0) | (F.size(free) > 0), F.col("clean")).alias("clean")))
    active = found.filter("clean is not null")
    more = learned_spans(active, least_support, least_confidence, rounds).groupBy("_id", "mark").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    more = more.select(F.col("_id").alias("_lf_id"), F.col("mark").alias("_lf_mark"), "more")
    out = found.join(more, found["_id"].eqNullSafe(more["_lf_id"]) & (found["mark"] == more["_lf_mark"]), "left")
    plain = F.transform(F.coalesce("base", F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    every = F.when(F.col("more").isNull(), plain).otherwise(F.array_sort(F.concat(plain, "more")))
    return out.select(F.col("_id").alias(id_col), plain.alias("base"), every.alias("spans"))
