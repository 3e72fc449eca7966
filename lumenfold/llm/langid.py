"""Language identification by Bayesian fusion of text, declared language, address and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

BITS = 16
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = re.compile(rb"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z0-9#]+;", re.S | re.I)


def visible_text(html: str | None) -> bytes:
    """A page's text without scripts, styles, comments, tags and entities."""
    return _BLOCKS.sub(b" ", (html or "").encode("utf-8", "surrogatepass"))


def trigram_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b" " + b" ".join(data.lower().split()) + b" ", dtype=np.uint8).astype(np.uint64)
    if len(x) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = (((x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]) * _MUL) >> np.uint64(64 - BITS)
    return np.unique(h.astype(np.int64), return_counts=True)


def fit_text_model(labelled: DataFrame, max_rows: int = 8_000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Log-probabilities of hashed byte trigrams by language, from rows of text and lang.

    At most max_rows rows, the first by a hash of the text, are read: a documented bound.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                at, n = trigram_counts((text or "").encode("utf-8", "surrogatepass"))
                total.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))[at] += n
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": n[used]})

    rows = labelled.filter("lang is not null").select("text", "lang").orderBy(F.xxhash64("text"), "lang").limit(max_rows)
    stats = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(stats.lang.unique()) or ["und"]
    table = np.full((len(langs), 1 << BITS), smoothing)
    for k, lang in enumerate(langs):
        own = stats[stats.lang == lang]
        table[k, own.bucket] += own.n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def identify_languages(
    pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    strength: float = 20.0, temper: float = 0.1,
) -> DataFrame:
    """Per row of pages: id_col, lang, confidence and the evidence text_lang, declared, suffix, host.

    Text gives tempered trigram likelihoods. How far a declared language (html lang) and an
    address suffix (a language as first path part, or the last label of the host) can be trusted
    is counted over all pages: P(value | language), from the text's posteriors. The prior of a
    host is smoothed towards its domain's, and that towards the global one, each with `strength`
    pages; a page's own posterior is left out of its host's counts. Null and empty pages have no
    text evidence and follow the other kinds; without any evidence the global prior decides.
    Rows that repeat an id are rows of their own; an empty table gives an empty result.
    """
    langs, table = model
    shared = pages.sparkSession.sparkContext.broadcast(table)
    k = len(langs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logp = shared.value
        for batch in batches:
            out = []
            for html in batch["_html"]:
                at, n = trigram_counts(visible_text(html))
                score = temper * (logp[:, at] @ n) if len(at) else np.zeros(k)
                out.append(score - score.max())
            frame = batch.drop(columns="_html")
            frame["_id"] = frame["_id"].astype("Int64")
            frame["loglik"] = pd.Series(out, dtype=object, index=frame.index)
            yield frame

    url = F.lower(F.coalesce(url_col, F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", 1)
    known = [F.lit(x) for x in langs]
    last = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(html_col).alias("_html"), host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.lower(F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"),
        F.when(path.isin(known), path).when(last.isin(known), last).otherwise("").alias("suffix"),
    )
    scored = materialize(rows.mapInPandas(run, "_id long, host string, domain string, declared string, suffix string, loglik array<double>"))

    def normal(logs):
        top = F.array_max(logs)
        raw = F.transform(logs, lambda x: F.exp(x - top))
        return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))

    scored = scored.withColumn("post", normal(F.col("loglik")))
    sums = [F.sum(F.col("post")[i]).alias(f"p{i}") for i in range(k)]
    total = scored.agg(*sums).first()
    mass = [(total[i] or 0.0) + 1.0 for i in range(k)]
    prior = [m / sum(mass) for m in mass]

    def trust(column: str) -> DataFrame:
        seen = scored.groupBy(column).agg(*sums, F.count("*").alias("_n"))
        return seen.select(column, "_n", F.array(*[F.when(F.col(column) == "", 0.0).otherwise(F.log((F.col(f"p{i}") + 0.5) / (mass[i] + 0.5 * (k + 1)))) for i in range(k)]).alias(f"{column}_log"))

    hosts = scored.groupBy("host", "domain").agg(*sums, F.count("*").alias("pages"))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"p{i}").alias(f"d{i}") for i in range(k)])
    hosts = materialize(hosts.join(domains, "domain"))
    # one host, or one value of the others, may hold a third of all pages
    n_pages = int(hosts.agg(F.sum("pages")).first()[0] or 0)
    joined = join_hot(scored, hosts, ["host", "domain"], "pages", n_pages)
    for column in ("declared", "suffix"):
        joined = join_hot(joined, materialize(trust(column)), [column], "_n", n_pages).drop("_n")
    n_dom, n_host = sum(F.col(f"d{i}") for i in range(k)), sum(F.col(f"p{i}") for i in range(k))
    logs = []
    for i in range(k):
        dom = (F.greatest(F.col(f"d{i}") - F.col("post")[i], F.lit(0.0)) + strength * prior[i]) / (F.greatest(n_dom - 1, F.lit(0.0)) + strength)
        own = (F.greatest(F.col(f"p{i}") - F.col("post")[i], F.lit(0.0)) + strength * dom) / (F.greatest(n_host - 1, F.lit(0.0)) + strength)
        logs.append(F.log(own) + F.col("declared_log")[i] + F.col("suffix_log")[i] + F.col("loglik")[i])
    names = F.array(*known)
    out = joined.withColumn("fused", normal(F.array(*logs)))
    best = F.array_max("fused")
    return out.select(
        F.col("_id").alias(id_col), F.element_at(names, F.array_position("fused", best).cast("int")).alias("lang"), best.alias("confidence"),
        F.when(F.array_max("loglik") > F.array_min("loglik"), F.element_at(names, F.array_position("post", F.array_max("post")).cast("int"))).alias("text_lang"),
        F.when(F.col("declared") != "", F.col("declared")).alias("declared"), F.when(F.col("suffix") != "", F.col("suffix")).alias("suffix"), "host",
    )
