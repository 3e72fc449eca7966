"""Language fusion, toxicity and quality against plain Python over few rows."""

from collections import Counter, defaultdict
from math import exp, log

import numpy as np
from test_operators import docs_of

from lumenfold.llm import langid, quality, toxicity


def test_language_fusion_in_plain_python(spark):
    model = (["de", "en"], np.log(np.random.default_rng(1).uniform(0.5, 2, (2, 1 << langid.BITS))))
    pages = [(k, f"http://{'big' if k < 30 else 'h%d' % (k % 4)}.site{k % 2}.{'de' if k % 5 == 0 else 'com'}/{'en/' if k % 7 == 0 else ''}x", f"<html lang={'de' if k % 3 else 'en'}>text {k} and {'der die das' * (k % 4)}</html>") for k in range(60)]
    pages += [(60, None, None), (61, "", ""), (61, "", "")]
    rows = []
    for k, url, html in pages:
        at, n = langid.trigram_counts(langid.visible_text(html))
        score = [0.1 * sum(model[1][i][a] * c for a, c in zip(at, n)) for i in range(2)]
        host = (url or "").split("//")[-1].split("/")[0]
        domain = ".".join(host.split(".")[-2:]) if host.count(".") else ""
        suffix = "en" if "/en/" in (url or "") else "de" if host.endswith(".de") else ""
        loglik = [s - max(score) for s in score]
        post = [exp(x) / sum(map(exp, loglik)) for x in loglik]
        rows.append((k, host, domain, "" if not html else "de" if "lang=de" in html else "en", suffix, loglik, post))
    mass = [1 + sum(r[6][i] for r in rows) for i in range(2)]
    prior = [m / sum(mass) for m in mass]
    sums = defaultdict(lambda: [0.0, 0.0])
    for r in rows:
        for key in (("h", r[1], r[2]), ("d", r[2]), ("l", r[3]), ("s", r[4])):
            for i in range(2):
                sums[key][i] += r[6][i]
    want = []
    for r in rows:
        logs = []
        for i in range(2):
            d, h = sums["d", r[2]], sums["h", r[1], r[2]]
            dom = (max(0, d[i] - r[6][i]) + 20 * prior[i]) / (max(0, sum(d) - 1) + 20)
            own = (max(0, h[i] - r[6][i]) + 20 * dom) / (max(0, sum(h) - 1) + 20)
            trust = [0.0 if not v else log((sums[c, v][i] + 0.5) / (mass[i] + 1.5)) for c, v in (("l", r[3]), ("s", r[4]))]
            logs.append(log(own) + sum(trust) + r[5][i])
        want.append((r[0], round(max(exp(x - max(logs)) for x in logs) / sum(exp(x - max(logs)) for x in logs), 9)))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = [(r["page_id"], round(r["confidence"], 9)) for r in langid.identify_languages(frame, model).collect()]
    assert sorted(got) == sorted(want)
    assert langid.identify_languages(frame.limit(0), model).count() == 0


def plain_buckets(text):
    data = b" " + (text or "").encode().lower() + b" "
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(data) - n + 1):
            h = int.from_bytes(data[i : i + n], "big") % 2**64
            out.add(((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS))
    return out


def test_toxicity_ratios_and_scores_in_plain_python(spark):
    texts = [("you rotten fool %d" % k, 1) if k % 3 == 0 else ("a calm and kind word %d" % k, 0) for k in range(60)] + [(None, 0), ("", 0), ("same", 1), ("same", 1)]
    frame = spark.createDataFrame(texts, "text string, label int")
    model = toxicity.fit_toxicity(frame.repartition(3), smoothing=5.0, least_ratio=0.5, rounds=200)
    counts = [Counter(), Counter()]
    for t, y in texts:
        counts[y].update(plain_buckets(t))
    toxic, clean = sum(y for _, y in texts), sum(1 - y for _, y in texts)
    prior = toxic / (toxic + clean)
    for b in set(counts[0]) | set(counts[1]):
        ratio = log((counts[1][b] + 5 * prior) / (5 * prior + toxic)) - log((counts[0][b] + 5 * (1 - prior)) / (5 * (1 - prior) + clean))
        assert (model.weights[b] == 0) == (abs(ratio) < 0.5)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of(spark, [t for t, _ in texts]), model).collect()}
    for k, (t, y) in enumerate(texts):
        assert np.isclose(scored[k], 1 / (1 + exp(-model.bias - sum(model.weights[b] for b in plain_buckets(t))))) and (t in (None, "") or (scored[k] > 0.5) == bool(y))
    few = toxicity.fit_toxicity(frame, max_rows=1)
    assert (few.weights == 0).all()


def test_quality_fit_is_a_minimum_of_the_plain_loss(spark):
    g = np.random.default_rng(2)
    rows = [(" ".join(g.choice(["alpha", "beta", "GAMMA", "12", "delta!"], p=p, size=30)), grade) for grade, p in enumerate(([0.6, 0.1, 0.1, 0.1, 0.1], [0.3, 0.4, 0.1, 0.1, 0.1], [0.1, 0.6, 0.1, 0.1, 0.1])) for _ in range(40)]
    rows += [(None, 0), ("", 1), rows[0], rows[0]]
    frame = spark.createDataFrame(rows, "text string, grade int")
    model = quality.fit_quality(frame, 3, rounds=600, l2=1e-3)
    cache = quality.Buckets(), {}
    found = [(quality.text_features(t, *cache), y) for t, y in rows]

    def loss(w, theta):
        total = 0.0
        for (at, x), y in found:
            z = float(w[at] @ x)
            above = [1.0, *[1 / (1 + exp(-(z - t))) for t in theta], 0.0]
            total -= log(max(above[y] - above[y + 1], 1e-9))
        return total / len(found) + 5e-4 * float((w * w).sum())

    best = loss(model.weights, model.thresholds)
    assert (np.diff(model.thresholds) > 0).all() and best < loss(np.zeros_like(model.weights), np.array([-0.5, 0.5]))
    used = np.unique(np.concatenate([at for (at, _), _ in found]))
    for at in used[:12]:
        for step in (-0.3, 0.3):
            w = model.weights.copy()
            w[at] += step
            assert loss(w, model.thresholds) > best - 1e-3
    for k in range(2):
        for step in (-0.15, 0.15):
            theta = model.thresholds.copy()
            theta[k] += step
            assert loss(model.weights, theta) > best - 1e-3
    out = {r["doc_id"]: r for r in quality.score_quality(docs_of(spark, [t for t, _ in rows]), model).collect()}
    for k, ((at, x), _) in enumerate(found):
        tails = 1 / (1 + np.exp(-(float(model.weights[at] @ x) - model.thresholds)))
        assert np.isclose(out[k]["expected_grade"], tails.sum()) and np.isclose(out[k]["tail_probability"], tails[0]) and out[k]["kept"] == (tails[0] >= 0.5)
