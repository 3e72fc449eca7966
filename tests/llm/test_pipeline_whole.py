"""The pipeline from end to end against plain Python; the classifier's scores are its own, what is done with them is not."""

import hashlib
import random
from collections import Counter
from math import exp

import corpus_pipeline
from test_decontam_brute import plain_covered
from test_operators import components, shingles
from test_whole_jobs import lines_gone

from lumenfold.llm import decontam, toxicity
from lumenfold.llm.common import held_out
from lumenfold.llm.queries import MIX, MIX_SEED


def write_tables(spark, root):
    r = random.Random(21)
    words = ["term" + a + b for a in "abcdefghij" for b in "klmnopqr"]
    bad = ["vile" + a for a in "stuvwxyz"]
    sentence = lambda n, some: " ".join(r.choice(some) for _ in range(n))
    items = [sentence(18, words) for _ in range(4)]
    docs = []
    for k in range(140):
        some = words + bad * 12 if k % 7 == 0 else words
        docs.append([sentence(r.randint(5, 14), some) for _ in range(r.randint(2, 6))])
    for k in range(0, 40, 4):  # near lines, near documents, passages
        line = docs[k][0].split(" ")
        line[1] = "changed"
        docs.append([" ".join(line), sentence(9, words)])
        docs.append([*docs[k + 1][:-1], docs[k + 1][-1] + " extra"])
        docs.append([sentence(7, words), sentence(6, words) + " " + r.choice(items) + " " + sentence(6, words)])
    docs += [["short line"], ["Short line!"], [""], [" "], ["one two three"]]
    rows = [(k, "\n".join(x), "en", r.choice(["src0", "src1", "src2", "src7", None]), len("\n".join(x))) for k, x in enumerate(docs)] + [(1000, None, "en", "src0", None), (1001, docs[5][0] + "\n" + sentence(9, words), None, "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 7 == 0)) for k in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return rows, items


def plain_run(rows, items, scores):
    rows = [x for x in rows if scores[x[0]] < corpus_pipeline.TOXIC]
    rows.sort()
    gone, kept = lines_gone([x[1] for x in rows]), []
    gone = {g[:2] for g in gone}
    for i, (doc, text, lang, source, n) in enumerate(rows):
        lines = [] if text is None else text.split("\n")
        left = [x for k, x in enumerate(lines) if (i, k) not in gone]
        if text is not None and len(left) < len(lines):
            text = "\n".join(left)
            if not text.strip(" \t\n\x0b\x0c\r"):
                continue
        kept.append((doc, text, lang, source, None if text is None else len(text)))
    sets = [shingles(x[1]) for x in kept]
    links = [(i, j) for i in range(len(kept)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    kept = [x for i, (x, c) in enumerate(zip(kept, components(len(kept), links))) if c == i]

    def leaks(text):
        doc = (text or "").split()
        for item in (x.split() for x in items):
            w = decontam.seed_width(len(item))
            if {tuple(item[i : i + w]) for i in range(len(item) - w + 1)} & {tuple(doc[i : i + w]) for i in range(len(doc) - w + 1)} and plain_covered(item, doc) >= 0.5:
                return True
        return False

    kept = [x for x in kept if not leaks(x[1])]
    counts = Counter(x[3] if x[3] in MIX else None for x in kept)
    out = []
    for x in kept:
        name = x[3] if x[3] in MIX else None
        rate = (MIX[name] if name else 1 - sum(MIX.values())) * len(kept) / counts[name]
        u = int(hashlib.md5(f"{MIX_SEED}:{x[0]}".encode()).hexdigest()[:13], 16) / 2**52
        term = total = exp(-rate)
        n = 0
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        out += [(*x, k, hashlib.md5(f"order {MIX_SEED}:{x[0]}:{k}".encode()).hexdigest()) for k in range(n)]
    return out


def test_run_is_the_plain_pipeline(spark, tmp_path):
    root = str(tmp_path / "in")
    rows, items = write_tables(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    scores = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(docs, toxicity.toxicity_model(spark, root, ~held_out())).collect()}
    assert 5 < sum(s >= corpus_pipeline.TOXIC for s in scores.values()) < 40
    out = corpus_pipeline.run(spark, root)
    got = [(x["doc_id"], x["text"], x["lang"], x["source"], x["n_chars"], x["copy"], x["shuffle_key"]) for x in out.collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    want = plain_run(rows, items, scores)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 60
