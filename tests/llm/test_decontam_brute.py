"""Decontamination of items without slots against every placing in every document."""

import random
import re

import pytest
from test_operators import docs_of

from lumenfold.llm import decontam

WORDS = ["word" + "".join(c) for c in zip("abcdefghijklmnop" * 4, "qrstuvwxyz" * 7)]


def plain_covered(item, doc):
    """Share of the item's words that align in the best placing anywhere: 1 - edits / words."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for word in doc:
        row = [0] + [min(row[i - 1] + (item[i - 1] != word), row[i] + 1) for i in range(1, len(item) + 1)]
        for i in range(1, len(item) + 1):  # words of the item that the document lacks
            row[i] = min(row[i], row[i - 1] + 1)
        best = min(best, row[-1])
    return 1 - best / len(item)


def corpus():
    r = random.Random(12)
    vocabulary = sorted(set(WORDS))
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (4, 5, 6, 8, 11, 14, 15, 16, 20, 25, 33, 40)]
    texts = []
    for item in items:
        for keep in (1.0, 0.9, 0.75, 0.6, 0.5, 0.45, 0.3):
            copy = [w if r.random() < keep else r.choice(vocabulary) for w in item]
            if r.random() < 0.3:
                del copy[r.randrange(len(copy))]
            texts.append([r.choice(vocabulary) for _ in range(r.randrange(30))] + copy + [r.choice(vocabulary) for _ in range(r.randrange(30))])
        half = len(item) // 2
        texts += [item[:half], item[: half + 1] + ["between"] * 3 + item[half + 1 :], item[half:] + item[:half], item + item]
    texts += [[r.choice(vocabulary) for _ in range(80)] for _ in range(30)]
    return items, texts


@pytest.mark.parametrize("max_windows", [2_000_000, 5])
def test_every_placing(spark, max_windows):
    items, texts = corpus()
    want = {}
    for d, doc in enumerate(texts):
        for k, item in enumerate(items):
            w = decontam.seed_width(len(item))
            shared = {tuple(item[i : i + w]) for i in range(len(item) - w + 1)} & {tuple(doc[i : i + w]) for i in range(len(doc) - w + 1)}
            if shared and (covered := plain_covered(item, doc)) >= 0.5:
                want[d, k] = covered
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, [" ".join(x) for x in texts] + [None, "", " \n"]).repartition(4)
    got = {(x["doc_id"], x["item_id"]): (x["covered"], x["verbatim"]) for x in decontam.contaminated(docs, bench, max_windows=max_windows).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    for key, (covered, verbatim) in got.items():
        assert abs(covered - want[key]) < 1e-9
        assert verbatim == bool(re.search(rf"(^| ){' '.join(items[key[1]])}( |$)", " ".join(texts[key[0]])))


def test_null_ids_and_long_documents(spark):
    item = "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn"
    bench = spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, item), (5, "x " * 30_000 + item + " y" * 30_000), (5, item), (6, None)], "doc_id long, text string")
    got = sorted((x["doc_id"] or -1, x["item_id"], x["verbatim"]) for x in decontam.contaminated(docs, bench).collect())
    assert got == [(-1, 1, True), (5, 1, True)]


def test_tokens_of_a_text_are_hashed_once(monkeypatch):
    """Also where a text has more than are kept; before, each time they had gone, and each token was a pair of Python numbers."""
    hashed, xxh = [], decontam.xxhash.xxh64_intdigest
    monkeypatch.setattr(decontam.xxhash, "xxh64_intdigest", lambda b: hashed.append(b) or xxh(b))
    text = "Tom has 12 mm of é wire. Tom sold 7 cm of it!"
    want = [x.tolist() for x in decontam.template(text, decontam.Tokens())]
    tokens, once = decontam.Tokens(), len(hashed)
    tokens.most = 3
    for k in range(1, 4):
        assert [x.tolist() for x in decontam.template(text, tokens)] == want
        assert len(hashed) == once * (k + 1) and once == len({*decontam._TOKEN.findall(text)})
    assert [len(x) for x in decontam.template("", tokens)] == [0] * 4 and [len(x) for x in decontam.template(None, tokens)] == [0] * 4
    assert want[2][0] == xxh(b"tom") and want[1] == [0, 0, 2, 3, 0, 0, 0, 0, 0, 2, 3, 0, 0]
