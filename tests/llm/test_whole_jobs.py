"""Operators against what their whole job is: every pair, every item, every row."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F
from test_operators import components, docs_of, plain_edit

from lumenfold.llm import decontam, line_dedup


def lines_gone(texts, min_words=5):
    """By all pairs and edit similarity alone: line -> the line that stays."""
    split = {(i, k): [w for w in (w.strip(line_dedup.EDGES) for w in x.lower().split(" ")) if w] for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))}
    places = sorted(p for p, w in split.items() if w)
    links = []
    for i, p in enumerate(places):
        for j in range(i):
            a, b = split[p], split[places[j]]
            most = max(len(a), len(b))
            if a == b or (min(len(a), len(b)) >= max(min_words, 0.75 * most) and plain_edit(a, b) <= 0.25 * most):
                links.append((i, j))
    return {(*places[i], *places[c]) for i, c in enumerate(components(len(places), links)) if c != i}


def test_line_dedup_finds_every_pair_by_edit_similarity(spark):
    r = random.Random(8)
    words = ["u%d" % i for i in range(150)] + ["the"] * 60
    lines = [[r.choice(words) for _ in range(n)] for n in range(5, 65)]
    for line in list(lines):
        n = len(line)
        for edits in {1, max(1, n // 8), n // 4}:
            more = list(line)
            for _ in range(edits):
                at, how = r.randrange(len(more)), r.randrange(3)
                more[at : at + (how > 0)] = [] if how == 2 else [r.choice(words)]
            lines.append(more)
    lines += [["too", "short"], ["Too", "short!"], ["short", "too"], ["one", "two", "three", "four"], ["one", "two", "three", "five"]]
    r.shuffle(lines)
    texts = ["\n".join(" ".join(x) for x in lines[i : i + 3]) for i in range(0, len(lines), 3)] + [None, "", "\n \n"]
    want = lines_gone(texts)
    assert len(want) > 100
    assert {tuple(x) for x in line_dedup.duplicate_lines(docs_of(spark, texts).repartition(4), distance=None).collect()} == want


def test_decontamination_finds_edited_items(spark):
    r = random.Random(3)
    words = ["q" + "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    items = {n: [r.choice(words) for _ in range(n)] for n in range(15, 41)}
    texts, want = [], set()
    for n, item in items.items():
        places = [(k,) for k in range(n)] + [(k, r.randrange(n)) for k in range(n)]
        for k, edited in enumerate(places):
            copy = list(item)
            for at in edited:
                copy[at] = "changed" if k % 3 else "changed twice" if k % 2 else ""
            want.add((len(texts), n))
            texts.append("Before it. " + " ".join(copy) + ", and after")
    clean = len(texts)
    texts += [" ".join(r.choice(words) for _ in range(200)) for _ in range(20)]
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == want and clean not in {d for d, _ in got}


def test_decontamination_finds_every_item_as_written(spark):
    items = ["Add 12, 15, 18, 21, 24 and 30", "What is 7?", "Compare seven green apples with pears", "Ask Anna Berg and Carl Dahl, then Eva Falk"]
    texts = [f"They said, {x}" for x in items] + [x.upper() for x in items] + [f"and so: {x.lower()} it was" for x in items] + ["What is 8 and add 12"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (10**6, 0):
        got = {(x["doc_id"], x["item_id"]): x["verbatim"] for x in decontam.contaminated(docs_of(spark, texts), bench, max_windows=most).collect()}
        assert got == {(i, i % 4): True for i in range(12)}


def test_stages_decide_by_row(spark):
    import corpus_pipeline
    from lumenfold.llm import common

    sf = "/root/testdata/sf0.001"
    item = common.table(spark, sf, "benchmark").first()["text"]
    kept = lambda stage, texts, ids: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs_of(spark, texts, ids).repartition(3), sf).collect()), key=str)
    plain = " ".join("plain%d" % i for i in range(30))
    assert kept(corpus_pipeline.decontamination_stage, [item, plain, item, plain], [None, None, 4, 4]) == [(4, plain), (None, plain)]
    assert kept(corpus_pipeline.ngram_join_stage, [plain, plain, plain, item, item, item], [7, 7, None, 7, None, None]) == sorted([(7, plain), (7, item)], key=str)
    own = ["one%d two three four five six" % i + " seven%d eight%d" % (i, i) * 3 for i in range(3)]
    texts = [f"{plain}\n{own[0]}", f"{own[1]}\n{plain}", f"{plain}\n{own[2]}"]
    left = [t for _, t in kept(corpus_pipeline.line_dedup_stage, texts, [None, None, None])]
    assert sorted("\n".join(left).split("\n")) == sorted([plain, *own])


def test_long_lines_link_across_sizes(spark):
    r = random.Random(4)
    long = ["k%d" % r.randrange(20_000) for _ in range(32_780)]
    docs = docs_of(spark, [" ".join(long), " ".join(long[:32_760])])
    for distance in (3, None):
        assert [tuple(x) for x in line_dedup.duplicate_lines(docs, distance=distance).collect()] == [(1, 0, 0, 0)]


def test_gram_blocks_find_near_lines_of_every_length(spark):
    """By edit similarity alone: of pairs with up to a quarter of their words changed nine in ten are found, and nothing else."""
    r = random.Random(11)
    words = ["n%d" % i for i in range(3000)] + ["the"] * 300
    want, lines = {}, []
    for n in [5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 18, 24, 40, 60, 90, 200] * 12:
        line = [r.choice(words) for _ in range(n)]
        more = list(line)
        for at in r.sample(range(n), r.choice([1, n // 4, n // 4])):
            more[at] = r.choice(words)
        if 4 * plain_edit(line, more) <= n and line != more:
            want[len(lines)] = n
            lines += [line, more]
    docs = docs_of(spark, [" ".join(x) for x in lines])
    got = {(x["keep_id"], x["_id"]) for x in line_dedup.duplicate_lines(docs.repartition(4), distance=None, grams=16).collect()}
    assert got <= {(k, k + 1) for k in want}
    for lo, hi in ((5, 8), (8, 12), (12, 20), (20, 61), (61, 300)):
        some = [k for k, n in want.items() if lo <= n < hi]
        assert len(some) > 15 and sum((k, k + 1) in got for k in some) >= 0.9 * len(some), (lo, hi)


def test_gram_blocks_on_edges_and_large_groups(spark):
    r = random.Random(12)
    base = ["z%d" % i for i in range(40)]
    texts = [" ".join(base[:k] + ["y%d" % r.randrange(9999)] + base[k + 1 :]) for k in range(40) for _ in range(20)]
    texts += [None, "", "\n \n", "one two", "One two!", " ".join(base)]
    gone = line_dedup.duplicate_lines(docs_of(spark, texts).withColumn("block", F.lit(1)), distance=None, grams=16).collect()
    assert {x["keep_id"] for x in gone} == {0, 803} and len(gone) == 801
    assert line_dedup.duplicate_lines(docs_of(spark, texts).limit(0), distance=None, grams=16).count() == 0
    same = docs_of(spark, ["a b c d e f"] * 4 + ["a b c d e x"], [None, None, 3, 3, None])
    assert [(x["_id"], x["keep_id"]) for x in line_dedup.duplicate_lines(same, distance=None, grams=16).collect()] == [(3, None), (3, None)]


def test_stages_on_empty_tables_and_clashing_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    plain = [" ".join("own%d_%d" % (k, i) for i in range(30)) for k in range(3)]
    docs = docs_of(spark, [*plain, None, "", plain[0]]).withColumn("_row", F.lit(7)).withColumn("_was", F.lit(8)).withColumn("_lf_gone", F.lit(9)).withColumn("_lf_times", F.lit(1)).withColumn("row", F.lit(2)).withColumn("score", F.lit(3))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        assert [c for c in out.columns if c not in ("copy", "shuffle_key")] == docs.columns, name
        rows = out.filter("_row = 7 and _was = 8 and _lf_gone = 9 and _lf_times = 1 and row = 2 and score = 3").select("doc_id").collect()
        assert len(rows) == out.count() and (name == "source_mixing" or {r["doc_id"] for r in rows} >= {0, 1, 2, 3}), name


def test_tiles_of_lists_meet_in_rounds_and_texts_go_early(spark, monkeypatch):
    """Unlike lines that share a phrase stand in one list, whose tiles (of a few lines here) meet a share at a time; before, all at once."""
    r = random.Random(6)
    own = [["t%d_%d" % (k, i) for i in range(6)] + ["in", "any", "case"] for k in range(60)]
    lines = [" ".join(x) for x in own] + [" ".join([*x[:5], "other", *x[6:]]) for x in own[::3]]
    r.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    met, meet, free = [], line_dedup._tile_links, line_dedup.new_path
    deleted, paths = [], []
    monkeypatch.setattr(line_dedup, "TILE", 8)
    monkeypatch.setattr(line_dedup, "_tile_links", lambda members, near: met.append(members.count()) or meet(members, near))
    monkeypatch.setattr(line_dedup, "new_path", lambda s: paths.append(free(s)) or paths[-1])
    monkeypatch.setattr(line_dedup, "delete", lambda s, path: deleted.append(path))
    gone = line_dedup.duplicate_lines(docs_of(spark, texts).repartition(4), distance=None, grams=16).collect()
    assert {tuple(x) for x in gone} == lines_gone(texts) and len(gone) == 20
    assert len(met) == line_dedup.ROUNDS and 0 < max(met) < sum(met) / 2
    assert sorted(deleted) == sorted(paths) and "code" in spark.read.parquet(deleted[0]).columns


def test_links_of_a_tile_are_no_more_than_its_lines(spark, monkeypatch):
    """Lines near each other, of which the smallest of their lists is near few: before, each pair of them was a link."""
    r = random.Random(3)
    base = ["q%d" % i for i in range(24)]
    lines = [" ".join(base[:k] + ["p%d" % r.randrange(999)] + base[k + 1 :]) for k in range(0, 24, 2) for _ in range(8)]
    lines += [" ".join(["o%d_%d" % (k, i) for i in range(20)] + base[:4]) for k in range(40)]
    r.shuffle(lines)
    lines, links, meet = [*lines, "two words"], [], line_dedup._tile_links

    def tile_links(members, near):
        out = meet(members, near)
        links.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(line_dedup, "_tile_links", tile_links)
    for tile in (16, 256):
        monkeypatch.setattr(line_dedup, "TILE", tile)
        gone = line_dedup.duplicate_lines(docs_of(spark, lines).repartition(4), distance=None, grams=16).collect()
        assert {tuple(x) for x in gone} == lines_gone(lines)

    f = lambda k: F.struct(F.lit(1).alias("words"), F.lit(k).alias("at"))
    tile = spark.range(60).select(F.lit(1).alias("block"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.struct(F.lit(0).alias("part"), F.col("id").alias("key"), F.col("id").alias("comp"), f(0).withField("at", F.col("id")).alias("f")).alias("l"))
    for step, groups in ((2, 1), (60, 1), (20, 3)):
        near = (lambda a, b: F.abs(a["at"] - b["at"]) < step) if step != 20 else (lambda a, b: F.floor(a["at"] / 20) == F.floor(b["at"] / 20))
        rows = meet(tile, near).collect()
        assert len(rows) == 60 - groups and {x["cb"] for x in rows} == {k * 20 for k in range(groups)}
    assert links and all(n <= m for m, n in links)


def test_large_lists_make_rows_in_proportion_to_their_lines(spark, monkeypatch):
    """Unlike lines stand in one list here, cut into parts of a few; before, each was copied to every other part."""
    met, none = [], spark.createDataFrame([], "ca long, cb long")
    monkeypatch.setattr(line_dedup, "TILE", 8)
    monkeypatch.setattr(line_dedup, "gram_blocks", lambda u, blocks: F.array(F.lit(7).cast("long")))
    monkeypatch.setattr(line_dedup, "_in_rounds", lambda members, near: met.append(members.count()) or none)
    rows = []
    for n in (40, 160):
        own = [["s%d_%d" % (k, i) for i in range(8)] for k in range(n)]
        lines = [" ".join(x) for x in own] + [" ".join([*x[:3], "other", *x[4:]]) for x in own[::4]]
        met.clear()
        line_dedup.duplicate_lines(docs_of(spark, lines).repartition(4), distance=None, grams=16)
        rows.append(sum(met))
    assert rows[0] > 0 and rows[1] < 6 * rows[0], rows


def test_long_unlike_lines_of_a_tile_are_told_apart_by_their_words_counts(spark, monkeypatch):
    """Lines of 160 words of a small vocabulary have most of the 128 bits of a bitmap, so before all of them were compared word by word."""
    r = random.Random(8)
    words = ["v%d" % i for i in range(600)]
    lines = [[r.choice(words) for _ in range(160)] for _ in range(30)]
    table = line_dedup.code_table(docs_of(spark, [" ".join(x) for x in lines]), "doc_id", "text").withColumn("u", line_dedup._code_points(F.col("code")))
    known = table.select("key", F.struct("code", F.size("code").alias("words"), *line_dedup._bitmap("u")).alias("f")).cache()
    near = line_dedup.Near(known, 0.75)
    tile = known.select(F.lit(1).alias("block"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.struct(F.lit(0).alias("part"), "key", F.col("key").alias("comp"), near.slight().alias("f")).alias("l"))
    assert near.likely(tile).count() == 30
    monkeypatch.setattr(line_dedup, "_similar", lambda a, b, similarity: F.raise_error("compared").isNotNull())
    assert line_dedup._tile_links(tile, near).count() == 0


def test_counts_of_words_rule_out_no_near_lines(spark):
    """Repeats count as often as they stand there, in short and long lines."""
    r, pairs = random.Random(9), []
    for n in [5, 8, 13, 40, 160, 700] * 8:
        line = [r.choice(["a", "b", *["w%d" % i for i in range(n // 2)]]) for _ in range(n)]
        more = list(line)
        for at in r.sample(range(n), r.randrange(0, n // 4 + 1)):
            more[at] = r.choice(["a", "b", "c"])
        pairs += [(line, more), (line, r.sample(line, n)), (line, r.choices(line, k=n)), (["a"] * n, ["a"] * (n // 2) + ["b"] * (n - n // 2))]
    rows = spark.createDataFrame([(k, *[[zlib.crc32(w.encode()) % 50_000 for w in x] for x in p]) for k, p in enumerate(pairs)], "k int, a array<int>, b array<int>").repartition(4)
    facts = lambda c: F.struct(F.size(c).alias("words"), line_dedup._counted(F.col(c)).alias("counted"))
    got = {x["k"]: x["s"] for x in rows.select("k", line_dedup._shares(facts("a"), facts("b"), 0.75).alias("s")).collect()}
    for k, (a, b) in enumerate(pairs):
        common = sum((Counter(a) & Counter(b)).values())
        assert got[k] or 4 * common < 3 * len(a), k
        assert not got[k] or 4 * common >= 3 * len(a) - len(a) // 10, k
    assert sum(got.values()) > 90 and not all(got.values())


def test_codes_of_distinct_lines_go_before_the_result_is_read(spark, monkeypatch):
    """Before, they lay on disk until the stages behind had ended too."""
    deleted = []
    monkeypatch.setattr(line_dedup, "delete", lambda s, path: deleted.append(path))
    gone = line_dedup.duplicate_lines(docs_of(spark, ["a b c d e f", "A b c d e f", "one two three"]), distance=None, grams=16)
    assert {"first", "code"} <= set(spark.read.parquet(deleted[-1]).columns)
    assert [tuple(x) for x in gone.collect()] == [(1, 0, 0, 0)]
