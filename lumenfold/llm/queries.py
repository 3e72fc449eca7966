"""The operators bound to the tables: QUERIES by name, ORACLES for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, filter_audit, langid, line_dedup, mixing, ngram_join, pii, quality, repair, sharding, toxicity
from .common import held_out, table

#: op10: shares of the mix by source; the sources that aren't named share what is left.
MIX = {"src0": 0.10, "src1": 0.10, "src2": 0.02}
MIX_SEED = 20
#: op13: so many shards, in an order of this seed.
SHARDS, SHARD_SEED = 8, 13


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null conv_id is a conversation too: ids stand in a structure, which is never null."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    both = rows.unionByName(extra).withColumn("conv_id", F.struct("conv_id"))
    out = chat.format_reply_trees(chat.conversations_as_trees(both), branches=1)
    out = out.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree_id.conv_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH all_rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    length(replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\h'), '</turn>', '\t')) AS body,
    length(replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) AS head,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM all_rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_text_model(table(spark, sf_dir, "documents"))
    return langid.identify_languages(table(spark, sf_dir, "pages"), model)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), distance=None, grams=16)
    return gone.select(F.col("_id").alias("doc_id"), F.col("at").cast("long").alias("line"), F.col("keep_id").alias("keep_doc_id"), F.col("keep_at").cast("long").alias("keep_line"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM w
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good. A document stays if 1 or more is likelier than not."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    labels = table(spark, sf_dir, "labels").withColumn("grade", grade)
    docs = table(spark, sf_dir, "documents")
    graded = toxicity.labelled_sample(docs, labels, "grade", 6_000, ~held_out()).withColumnRenamed("label", "grade")
    return quality.score_quality(docs, quality.fit_quality(graded, 3)).withColumn("held_out", held_out())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.toxicity_model(spark, sf_dir, ~held_out())
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, MIX, MIX_SEED)


OP10_SQL = """
WITH RECURSIVE weights(source, w) AS (VALUES {weights}),
named AS (SELECT d.doc_id, d.source, d.text, w.source AS s FROM documents d LEFT JOIN weights w ON d.source = w.source),
counts AS (SELECT s, count(*) AS n FROM named GROUP BY s),
rates AS (SELECT c.s, CASE WHEN c.s IS NULL THEN {left} ELSE w.w END * (SELECT count(*) FROM documents) / c.n AS rate
  FROM counts c LEFT JOIN weights w ON c.s = w.source),
steps(s, rate, k, term, total) AS (
  SELECT s, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT s, rate, k + 1, term * (rate / (k + 1)), total + term * (rate / (k + 1)) FROM steps WHERE 1 - total > pow(2.0::DOUBLE, -52) AND k < 10 * rate + 100),
u AS (SELECT *, CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM named),
times AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM steps WHERE steps.s IS NOT DISTINCT FROM u.s AND steps.total <= u.u) AS n FROM u),
copies AS (SELECT doc_id, source, text, CAST(unnest(range(n)) AS INTEGER) AS copy FROM times)
SELECT doc_id, source, text, copy, md5('order {seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key FROM copies
""".format(weights=", ".join(f"('{s}', {w}::DOUBLE)" for s, w in MIX.items()), left=f"{max(0.0, 1 - sum(MIX.values()))!r}::DOUBLE", seed=MIX_SEED)


#: SQL has no CRC-32: its table of 256 words as the list crc_table.t, and the sum of a column's UTF-8 bytes.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """The CRC-32 of a text, where crc_table is joined."""
    octets = f"list_transform(string_split(regexp_replace(hex(encode({text})), '..', '\\0,', 'g'), ',')[:-2], lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT [f1, f2, f3, f4, f5] AS s FROM (SELECT f1.x AS f1, f2.x AS f2, f3.x AS f3, f4.x AS f4, f5.x AS f5 FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31)),
steps AS (SELECT array_to_string(s, '') AS filter_order, k AS step, (SELECT b FROM f WHERE x = s[k]) AS bit, coalesce((SELECT sum(b) FROM f WHERE list_contains(s[1:k-1], x)), 0)::INTEGER AS before FROM o, range(1, 6) r(k)),
done AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM done
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damage(table(spark, sf_dir, "conversations")))


OP12_SQL = (
    "WITH RECURSIVE " + CRC_TABLE + r""",
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS how FROM conversations, crc_table),
r AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS k FROM base WHERE how <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM r),
s AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS ini, last = '' AS blank, last <> '' AND seen > 1 AS dup, last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') AS cut,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM p)),
w AS (SELECT *, CASE WHEN blank OR dup THEN 1000 WHEN cut THEN 3 ELSE 0 END AS more FROM s),
n AS (SELECT conv_id, max(i) AS n, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id),
h(conv_id, i, c) AS (SELECT conv_id, n + 1, [0, 6, 3, 0] FROM n
  UNION ALL SELECT conv_id, i, [least(b[1], 3 + least(b[3], 3 + b[4])), least(b[2], 3 + least(b[3], 3 + b[4])), least(b[3], 3 + b[4]), least(b[4], 3 + b[3])] FROM (
    SELECT w.conv_id, w.i, [least(4 + c[1], more + least(CASE ini WHEN 's' THEN c[2] WHEN 'u' THEN c[3] ELSE 3 + c[3] END, 3 + c[3])), least(4 + c[2], more + CASE ini WHEN 'u' THEN c[3] ELSE 3 + c[3] END),
      least(4 + c[3], more + CASE ini WHEN 'a' THEN c[4] ELSE 3 + c[4] END), least(4 + c[4], more + CASE ini WHEN 'u' THEN c[3] ELSE 3 + c[3] END)] AS b
    FROM h JOIN w ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND w.i = h.i - 1)),
f(conv_id, i, q, audit, said) AS (SELECT conv_id, 1, 0, '', ''::VARCHAR FROM n
  UNION ALL SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN stay ELSE go END, audit || e,
    said || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE go WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END END FROM (
    SELECT f.*, role, text, CASE WHEN q = 2 THEN 3 ELSE 2 END AS go, CASE WHEN q = 0 AND ini = 's' THEN 1 WHEN q <> 2 AND ini = 'u' THEN 2 WHEN q = 2 AND ini = 'a' THEN 3 END AS stay,
      CASE WHEN 4 + a.c[q + 1] = b.c[q + 1] THEN 'D' WHEN 3 + b.c[go + 1] = b.c[q + 1] THEN 'I' WHEN more + a.c[stay + 1] = b.c[q + 1] THEN 'K' ELSE 'R' END AS e
    FROM f JOIN h b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.i LEFT JOIN h a ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND a.i = f.i + 1
      LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i WHERE w.i IS NOT NULL OR b.c[q + 1] > 0)),
done AS (SELECT f.conv_id, audit, said, b.c[1] AS cost FROM f JOIN h e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i JOIN n ON n.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = n + 1
  JOIN h b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = 1 WHERE e.c[q + 1] = 0)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM k.conv_id
"""
).replace("{crc}", crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS, SHARD_SEED)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = (
    "WITH " + CRC_TABLE + r""",
d AS (SELECT doc_id, coalesce(source, '') AS source, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {crc} AS text_crc32 FROM documents, crc_table),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, text_crc32) - 1 AS copy FROM d),
h AS (SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32 || ':' || copy), 1, 13))::BIGINT AS h FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32, copy) AS r, count(*) OVER (PARTITION BY source) AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY (2.0::DOUBLE * r - 1) / (2.0::DOUBLE * n), source) - 1 AS p, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * {shards} // total)::INTEGER AS shard, (p - ((p * {shards} // total) * total + {shards} - 1) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
).replace("{crc}", crc_sql("coalesce(text, '')")).replace("{seed}", str(SHARD_SEED)).replace("{shards}", str(SHARDS))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_ngram_jaccard_join, op3_language_id, op4_line_dedup, op5_exact_dedup, op6_benchmark_decontamination,
        op7_quality_classifier, op8_toxicity, op9_pii, op10_source_mixing,
        op11_filter_interaction_audit, op12_conversation_repair, op13_sharding, pipeline,
    )
}
ORACLES = {"op1_chat_formatting": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op10_source_mixing": OP10_SQL, "op11_filter_interaction_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_sharding": OP13_SQL}
