"""The training-data operators against brute force, round trips and held-out rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import chat, common, decontam, exact_dedup, langid, line_dedup, mixing, ngram_join, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=1, n=120):
    """Random texts with edits, repeats, nulls, blanks and one very long text."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 60))] for _ in range(n // 4)]
    texts = []
    for _ in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append("".join(w + r.choice([" ", " ", "  ", "\n"]) for w in words).upper() if r.random() < 0.2 else " ".join(words))
    return [*texts, None, "", " \n\t", "one two", "One  two", " ".join(vocabulary * 60)]


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("tile_rows", [512, 2])
def test_jaccard_components_against_all_pairs(spark, tile_rows):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = {(i, len(s), c) for i, (s, c) in enumerate(zip(sets, components(len(sets), links)))}
    assert len(links) > 50
    got = ngram_join.jaccard_components(docs_of(spark, texts).withColumn("sid", F.lit(1)).repartition(5), tile_rows=tile_rows)
    assert {tuple(r) for r in got.collect()} == want


def test_tile_bound_never_hides_a_link():
    r = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 63, 80, dtype=np.uint64))
        b = np.unique(np.r_[a[: r.integers(40, 80)], r.integers(0, 1 << 63, 9, dtype=np.uint64)])
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        width = min(len(x), len(y))
        x, y = ngram_join.fold([x], width)[0], ngram_join.fold([y], width)[0]
        assert len(a) - int(ngram_join._POP[x & ~y].sum()) >= len(np.intersect1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {tuple(r) for r in common.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 160)}


def test_chat_round_trip_and_branches(spark):
    odd = ["\\### Assistant: </turn> ok", "\\\\h\\t###", "", None, "a: b\n### x</turn>\n", "####</turn></turn>", "\\"]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(7) for t, r in enumerate(["system", "user", "assistant", None, "a:b"])]
    rows += [(None, 0, "user", "x"), (50, 0, "assistant", "twice"), (50, 0, "assistant", "twice")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("up", F.lit(3))
    out = chat.format_reply_trees(chat.conversations_as_trees(frame), branches=None)
    out = out.select("tree_id", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["tree_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in out.collect()}
    want = defaultdict(list)
    for c, _, role, text in rows:
        if c is not None:
            want[c].append((role or "", text or ""))
    assert got == {c: (turns, "".join(t for r, t in turns if r == "assistant")) for c, turns in want.items()}


def test_reply_tree_ranking_cycles_and_depth(spark):
    rows = [("t", i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(70)]
    rows += [("t", 100, 3, "assistant", "side", 99.0), ("t", 200, 201, "user", "loop", 1.0), ("t", 201, 200, "user", "loop", 1.0), ("u", 1, 77, "user", "orphan", None)]
    frame = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    best = {r["tree_id"]: r for r in chat.format_reply_trees(frame, branches=1).collect()}
    assert best["t"]["leaf_id"] == 100 and best["t"]["formatted"].count("</turn>") == 5 and set(best) == {"t", "u"}
    both = {(r["tree_id"], r["leaf_id"]): r["rank"] for r in chat.branch_paths(frame, 2).select("tree_id", "leaf_id", "rank").distinct().collect()}
    assert both == {("t", 100): 1, ("t", 69): 2, ("u", 1): 1}
    assert chat.format_reply_trees(frame.limit(0)).count() == 0


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_duplicates(spark, digest_all):
    texts = ["a b", "ab", "a  b", None, "", " ", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + " 1", "é a", "éa", "ab"]
    ids = [*range(11), 1]  # the last row repeats id and text of another
    got = exact_dedup.exact_duplicates(docs_of(spark, texts, ids).withColumn("norm", F.lit(0)), digest_all=digest_all).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g)) for g in groups.values() for _, i in g)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    if digest_all:
        assert {r["doc_id"]: r["digest"].hex() for r in got}[9] == hashlib.sha256("éa".encode()).hexdigest()


def plain_edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(5)
    words = ["v%d" % i for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(6, 60))] for _ in range(12)]
    lines = []
    for _ in range(150):
        line = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            line[r.randrange(len(line))] = r.choice(words)
        lines.append(" ".join(line).capitalize() + r.choice(["", ".", "!!"]))
    lines += ["too short line", "too short line"]
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [None, "", " ".join(words * 90), " ".join(words * 90)]
    docs = docs_of(spark, texts)
    sims = {(x["_id"], x["at"]): x["sim"] & (2**64 - 1) for x in line_dedup.line_table(docs, "doc_id", "text", 5).collect()}
    split = {(i, k): [w for w in (w.strip(line_dedup.EDGES) for w in line.lower().split(" ")) if w] for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))}
    places = sorted(p for p, w in split.items() if len(w) >= 5)
    links = []
    for i, p in enumerate(places):
        for j in range(i):
            a, b = split[p], split[places[j]]
            close = bin(sims[p] ^ sims[places[j]]).count("1") <= 3 and min(len(a), len(b)) >= 0.75 * max(len(a), len(b))
            if a == b or (close and plain_edit(a, b) <= 0.25 * max(len(a), len(b))):
                links.append((i, j))
    lead = components(len(places), links)
    want = {(*places[i], *places[c]) for i, c in enumerate(lead) if c != i}
    assert any(split[places[i]] != split[places[j]] for i, j in links)
    assert {tuple(x) for x in line_dedup.duplicate_lines(docs.repartition(4)).collect()} == want
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs.withColumn("key", F.lit(1))).collect()}
    gone = {w[:2] for w in want}
    assert out == {i: t if t is None or not any(g[0] == i for g in gone) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)}


def test_simhash_is_the_majority_of_word_hashes(spark):
    import xxhash

    texts = ["alpha beta gamma delta epsilon", "a b c d e f", " ".join("k%d" % i for i in range(700))]
    for row in line_dedup.line_table(docs_of(spark, texts), "doc_id", "text", 5).collect():
        hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in texts[row["_id"]].split()]
        assert row["sim"] & (2**64 - 1) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) // 2)


def test_decontamination(spark):
    item = "A train leaves Boston at 40 miles per hour and covers the long road to Albany in 12 hours while Peter waits there for 3 hours"
    again = item.replace("40", "55").replace("12", "7").replace("Peter", "Marta").replace("Boston", "Denver")
    mixed = item.replace("Boston", "Denver", 1)
    texts = ["Some words before. " + item.lower().replace("boston", "Boston").replace("albany", "Albany").replace("peter", "Peter") + " and after", again, mixed, "nothing of that kind is here at all, only other words in a row", None, "", item[:40]]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    for most in (10**6, 0):
        got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.contaminated(docs_of(spark, texts).withColumn("hash", F.lit(1)), bench, max_windows=most).collect()}
        assert got == {(0, 1): True, (1, 1): False, (2, 1): False}
    assert decontam.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_classifiers_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    labels = common.table(spark, sf, "labels")
    rows = queries.op8_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((rows.predicted == 1) == (rows.toxic == 1)).mean() > 0.93
    rows = queries.op7_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert (rows.kept == (rows.quality == 1)).mean() > 0.95
    out = toxicity.score_toxicity(docs_of(spark, [None, ""]), toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS), 0.0)).collect()
    assert [r["score"] for r in out] == [0.5, 0.5]
    none = spark.createDataFrame([], "text string, label int")
    assert toxicity.fit_toxicity(none).weights.sum() == 0
    assert (quality.fit_quality(none.withColumnRenamed("label", "grade"), 3).weights == 0).all()


def test_language_identification(spark):
    got = queries.op3_language_id(spark, SF.replace("0.001", "0.01")).toPandas()
    assert (got.text_lang == got.suffix)[got.suffix.notna()].mean() > 0.9 and got.lang.notna().all()
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://a.de/x", "<html lang=de>der und die das ist nicht ein</html>")], "page_id long, url string, html string")
    model = langid.fit_text_model(common.table(spark, SF, "documents"))
    assert {r["page_id"] for r in langid.identify_languages(pages, model).collect()} == {1, 2, 3}


def brute_pii(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_pii_base_spans_against_python(spark):
    r = random.Random(2)
    bits = ["a.b@c.d", "x@y", "@", ".", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (988) 555-2485", "+", "12", " ", "é𝄞", "\x01", "\x02", "-", "a@b.c.@x.y", "+49((30)1234567", "79927398713", "0" * 16, "\n", "word"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(600)] + [None, "", "1 " * 4000, "a@" + ".b" * 6000, "9" * 20000]
    out = pii.find_pii(docs_of(spark, texts).withColumn("mark", F.lit(1)))
    got = {x["doc_id"]: x["b"] for x in out.select("doc_id", pii.span_text(F.col("base")).alias("b")).collect()}
    assert got == {i: brute_pii(t) for i, t in enumerate(texts)}


def test_jaccard_of_hot_short_texts_and_null_ids(spark):
    texts = ["one two three"] * 300 + ["one two four", None, None, "one two three"]
    ids = [*range(300), 300, None, None, None]
    got = [tuple(r) for r in ngram_join.jaccard_components(docs_of(spark, texts, ids).repartition(6)).collect()]
    assert sorted(got, key=str) == sorted([(i, 1, 0) for i in range(300)] + [(300, 1, 300), (None, 0, None), (None, 0, None), (None, 1, 0)], key=str)
    assert ngram_join.jaccard_components(docs_of(spark, texts).limit(0)).count() == 0


def test_pii_learns_contexts(spark):
    texts = [f"please call us {'on' if i % 2 else 'at'} +1 555 {100 + i} 4{i:03d} now" for i in range(20)]
    texts += ["please call us on 555 0199 777 now", "there were 1234567890 of them"]
    out = {x["doc_id"]: x["s"] for x in pii.find_pii(docs_of(spark, texts)).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert out[20] == "phone:18:30" and out[21] == ""


def test_pii_found_identifiers_induce_patterns(spark):
    number = lambda i: f"555 7{i:02d} 90{i % 10}"  # noqa: E731  too short for the base pattern
    texts = [f"please call us on +1 555 {100 + i} 4{i:03d} now" for i in range(20)]
    texts += [f"please call us on {number(i)} now" for i in range(8)]  # found by the seeds' pattern
    texts += [f"{'x' * 500} my extension {' ' * 60} {number(i)}" for i in range(8)]  # the same ones induce another, words far off
    texts += ["so my extension 555 799 909 rang", "rows of figures 555 123 456 here"]
    out = {x["doc_id"]: x["s"] for x in pii.find_pii(docs_of(spark, texts).repartition(3)).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()}
    assert all(out[i] for i in range(37)) and out[36] == "phone:16:27" and out[37] == ""
    assert pii.find_pii(docs_of(spark, texts).limit(0)).count() == 0
    odd = docs_of(spark, ["a@b.c", "a@b.c", None], [None, None, 3]).withColumn("mark", F.lit(1)).withColumn("loose", F.lit(2))
    assert sorted(x["s"] for x in pii.find_pii(odd).select(pii.span_text(F.col("spans")).alias("s")).collect()) == ["", "email:0:5", "email:0:5"]


def test_exact_duplicates_of_text_ids_and_hot_groups(spark):
    rows = [(f"k{i}", "same text") for i in range(40)] + [(None, "same  text"), (None, "other"), ("z", "other"), ("a", "Other")]
    got = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "id string, text string"), "id").collect()}
    assert got == {(f"k{i}", None, 41, False) for i in range(40)} | {(None, None, 41, True), (None, "z", 2, False), ("z", "z", 2, True), ("a", "a", 1, True)}


def test_scratch_tables_of_a_block_are_deleted(spark):
    from pathlib import Path

    with common.scratch(spark):
        frame = common.materialize(spark.range(5))
        folder = Path(common.scratch_dir(spark))
        assert frame.count() == 5 and any(folder.iterdir())
    assert not folder.exists()


def test_mixing_rates_and_repeatability(spark):
    docs = docs_of(spark, ["t"] * 4000).withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, None).otherwise("b"))
    out = mixing.mix_sources(docs, {"a": 0.5, "zzz": 0.0}, seed=1)
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["a"] - 2000) < 150 and abs(counts["b"] - 2000 * 2 / 3) < 150 and abs(counts[None] - 2000 / 3) < 100
    again = mixing.mix_sources(docs.repartition(7), {"a": 0.5, "zzz": 0.0}, seed=1)
    assert out.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).count() == 0
    assert mixing.mix_sources(docs.limit(0), {"a": 0.5}).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert docs.count() > 100, name
    held = [r["doc_id"] for r in decontam.contaminated(docs, common.table(spark, SF, "benchmark")).collect()]
    assert held == [] and ngram_join.jaccard_components(docs).filter("doc_id <> component_id").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 100
