"""Filter audit, conversation repair and sharding against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import common, filter_audit, repair, sharding

ODD_TEXTS = [None, "", " \t\n", "word", "A B C D", "a # b", "é" * 30 + " Ü", "x " * 99, "x " * 100, " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(20_000)), "AB" * 5 + "c" * 90, "AB" * 5 + "c" * 89]


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))


def plain_audit(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    parts = defaultdict(list)
    for i, text, part in rows:
        again = i is not None and i > least[text or ""]
        parts[part or ""].append((plain_mask(text or "") + 16 * again, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [d for d in left if d[0] & bit]
                left = [d for d in left if not d[0] & bit]
                fail = sum(1 for d in docs if d[0] & bit)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), fail - len(gone), sum(d[0] == bit for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit_against_plain_orders(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(40)] + ["Big", "BIG", "cost$", "a|b"]
    texts = ODD_TEXTS + [" ".join(r.choice(words) for _ in range(r.choice([3, 99, 100, 130]))) for _ in range(60)]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(200)]
    rows += [(None, texts[20], "en"), (None, texts[20], "de"), (7, rows[9][1], "fr"), (7, rows[9][1], "en"), (7, rows[9][1], "en")] + [(1000 + i, "copied text", "en") for i in range(100)] + rows[:5]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 1100, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("mask", "part", "digest", "id", "n", "good")})
    out = filter_audit.audit_filters(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("zz")))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(x["part"], x["filter_order"], x["step"]): [x[c] for c in columns] for x in out.collect()} == plain_audit(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def plain_repair(rows):
    """(turn, role, text) of each row -> the columns of op12, by comparing all (cost, audit) of each place and state."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "fine")
        seen.add((role, text))
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    best = {"0": (0, "", ())}
    todo = [best]
    for at in range(len(rows) + 1):
        now, queue = {}, [(v, q) for q, v in todo[at].items()]
        while queue:  # inserts
            queue.sort()
            v, q = queue.pop(0)
            if q not in now:
                now[q] = v
                for to, name in (("u", "user"), ("a", "assistant")):
                    if (q, to) in step:
                        queue.append(((v[0] + 3, v[1] + "I", (*v[2], name + ":")), step[q, to]))
        todo[at] = now
        if at < len(rows):
            _, role, text = rows[at]
            nexts = defaultdict(list)
            for q, (cost, audit, said) in now.items():
                nexts[q].append((cost + 4, audit + "D", said))
                if faults[at] not in ("blank", "duplicate"):
                    more = 3 * (faults[at] == "truncated")
                    if (q, role[:1]) in step:
                        nexts[step[q, role[:1]]].append((cost + more, audit + "K", (*said, f"{role}:{text}")))
                    for to, name in (("u", "user"), ("a", "assistant")):
                        if (q, to) in step:
                            nexts[step[q, to]].append((cost + more + 3, audit + "R", (*said, f"{name}:{text}")))
            todo.append({q: min(v) for q, v in nexts.items()})
    cost, audit, said = min(v for q, v in todo[-1].items() if q in "03")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()), said


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations(seed, n=150):
    r = random.Random(seed)
    texts = ["Fine.", "Good!", "Well?", "cut off", "cut. off", "", " \n", "Ok. ", "One.", "Two.", "Three.", "Four.", None, "long " * 3000 + "end.", "ünï.", "x" * 9000]
    rows = []
    for c in range(n):
        at = 0
        for _ in range(r.randrange(0, 12)):
            at += r.choice([1, 1, 1, 0, 2])
            rows.append((c, r.choice([at, at, at, None]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "", None, "u"]), r.choice(texts)))
    return rows + rows[:20] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, "user", "Hi.")] + [(10**6, k % 300, "user" if k % 3 else "assistant", f"Line {k % 40}.") for k in range(900)]


@pytest.mark.parametrize("points", [4096, 7])
def test_repair_against_all_edits(spark, points):
    rows = conversations(points)
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        damaged[conv] += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    want = {conv: plain_repair(x) for conv, x in damaged.items()}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("head", "digest", "times", "piece", "audit")})
    messages = repair.damage(table.repartition(5))
    out = repair.repair_conversations(messages)
    assert out.schema["conv_id"].dataType.typeName() == "long"
    got = {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in out.collect()}
    assert got == {conv: x for conv, (x, _) in want.items()}
    turns = repair.repaired_turns(messages, repair.audit_conversations(messages), points).collect()
    said = defaultdict(lambda: defaultdict(list))
    for x in sorted(turns, key=lambda x: x["part"]):
        said[x["conv_id"]][x["at"]].append((f"{x['role']}:" if x["part"] == 0 else "") + x["text"])
    assert {c: tuple("".join(v[k]) for k in sorted(v)) for c, v in said.items()} == {None if c is None else str(c): s for c, (_, s) in want.items() if s}
    hashes = {x["conv_id"]: x["repaired_sha256"] for x in repair.repaired_hashes(messages, repair.audit_conversations(messages), points).collect()}
    assert hashes == {None if c is None else str(c): x[-1] for c, (x, _) in want.items()}
    assert repair.repair_conversations(repair.damage(table.limit(0))).count() == 0


def test_machine_has_few_states(spark):
    r = random.Random(1)
    machine = repair.Machine()
    for _ in range(300):
        machine.repair("".join(r.choice("suaoSUAO-") for _ in range(200)))
    assert len(machine.states) < 100
    assert machine.repair("") == (0, "") and machine.repair("-" * 5) == (20, "DDDDD") and machine.repair("ua" * 50_000)[0] == 0


def plain_shards(rows, shards, seed):
    copies, alike = Counter(), []
    for i, source, text in rows:
        body = (text or "").encode()
        key = (i, source or "", len(body) + 1, zlib.crc32(body))
        alike.append((*key, copies[key]))
        copies[key] += 1
    by_source = defaultdict(list)
    for i, source, size, crc, copy in alike:
        h = int(hashlib.md5(f"{seed}:{'' if i is None else i}:{size}:{crc}:{copy}".encode()).hexdigest()[:13], 16)
        by_source[source].append((h, i is not None, i or 0, size, crc, copy))
    order = sorted(((2 * r - 1) / (2 * len(x)), source, row) for source, x in by_source.items() for r, row in enumerate(sorted(x), 1))
    out = []
    for p, (_, source, (_, there, i, size, crc, _)) in enumerate(order):
        shard = p * shards // len(order)
        out.append((i if there else None, source, size, crc, shard, p - -(-shard * len(order) // shards)))
    return out


def test_shards_match_the_mixture(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "UNFOLD", 3)
    r = random.Random(2)
    sources = ["a"] * 20 + ["b", "c", None, "", "d"]
    rows = [(i, r.choice(sources), r.choice([None, "", "same", "é" * r.randrange(9), f"text {i}"])) for i in range(500)]
    rows += [(None, "a", "x")] * 40 + [(5, "b", "twice")] * 2 + [(6, "b", "t1"), (6, "b", "t2"), (77, "rare", "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("shard", "slot", "copy", "h", "mark")})
    got = sharding.shard_rows(docs.repartition(7), 8, 13, buckets=16)
    seen = [(x["id"], x["source"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in got.collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(seen, key=key) == sorted(plain_shards(rows, 8, 13), key=key)
    sizes, by_source = Counter(x[4] for x in seen), Counter((x[1], x[4]) for x in seen)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for source in {x[1] for x in seen}:
        counts = [by_source[source, k] for k in range(8)]
        assert max(counts) - min(counts) <= 2  # a cut falls among equal fractional ranks
    assert sharding.shard_rows(docs.limit(0)).count() == 0
    sharding.write_shards(docs.repartition(3), str(tmp_path / "out"), 8, 13)
    for k in range(8):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [s for f in files for s in pq.ParquetFile(f).read(["slot"])["slot"].to_pylist()]
        assert slots == list(range(sizes[k]))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((x["id"], x["source"], x["text"]) for x in back.collect()), key=key) == sorted(((i, s or "", t or "") for i, s, t in rows), key=key)


def test_unfold_numbers_every_copy(spark, monkeypatch):
    monkeypatch.setattr(common, "UNFOLD", 3)
    rows = spark.createDataFrame([(k, n) for k, n in enumerate((1, 2, 3, 4, 8, 9, 10, 27, 28, 100))], "k int, n long")
    got = {}
    for x in common.unfold(rows, "n", "at").collect():
        got.setdefault((x["k"], x["n"]), []).append(x["at"])
    assert all(sorted(v) == list(range(n)) for (_, n), v in got.items()) and len(got) == 10
