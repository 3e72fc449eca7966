"""The columns of op9_pii against plain Python, row by row."""

import hashlib
import re
from collections import defaultdict

import pytest
import regex
from test_operators import brute_pii

from lumenfold.llm import pii, queries


def context(text, start):
    words = [w for w in regex.split(r"[^\p{L}]+", text[:start].lower()) if w]
    return " ".join(words[-2:]) if len(words) > 1 else None


def plain_learned(rows, support=5, confidence=0.5, rounds=4):
    """What patterns disclose: doc_id -> set of (start, rank, end)."""
    seeds, loose = set(), []
    for doc_id, text, base in rows:
        seeds |= {(k, text[s:e], context(text, s)) for s, k, e in base}
        for m in re.finditer(pii.LOOSE, text):
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                loose.append((doc_id, *m.span(), m[0], context(text, m.start())))
    seeds, loose = {s for s in seeds if s[2]}, [x for x in loose if x[4]]
    edges = {(x[4], x[3]) for x in loose}
    sizes, by_kind = defaultdict(int), defaultdict(int)
    for k, _, pattern in seeds:
        sizes[pattern] += 1
        by_kind[k, pattern] += 1
    for pattern, _ in edges:
        sizes[pattern] += 1
    belief = {}
    for _ in range(rounds):
        total, count = defaultdict(float, by_kind), defaultdict(int, by_kind)
        for (k, value), b in belief.items():
            for pattern, v in edges:
                if v == value:
                    total[k, pattern] += b
                    count[k, pattern] += b >= confidence
        sure = {key: total[key] / sizes[key[1]] for key in total if count[key] >= support}
        belief = {}
        for (k, pattern), c in sure.items():
            for p, value in edges:
                if p == pattern:
                    belief[k, value] = max(c, belief.get((k, value), 0))
    best = {}
    for (k, value), b in belief.items():
        if b >= confidence:
            best[value] = max(best.get(value, (0, -9)), (b, -k))
    out = defaultdict(set)
    for doc_id, start, end, value, _ in loose:
        if value in best:
            out[doc_id].add((start, -best[value][1], end))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op9_columns(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    base = {i: [(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in brute_pii(t).split(",") if x)] for i, t in docs.items()}
    more = plain_learned([(i, t, base[i]) for i, t in docs.items()])
    got = {r["doc_id"]: r for r in queries.op9_pii(spark, f"/root/testdata/{sf}").collect()}
    assert got.keys() == docs.keys() and any(base.values())
    for i, row in got.items():
        kinds = [k for _, k, _ in base[i]]
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [kinds.count(k) for k in range(4)]
        assert row["base_sha256"] == hashlib.sha256(brute_pii(docs[i]).encode()).hexdigest()
        assert row["spans"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted({*base[i], *more[i]}))
