"""The training-data queries of the registry and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, decontamination, html_extract, language_id, line_dedup, near_dedup, sharding, sort_means, toxicity, url_filter, whitening
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted before the removed lines are joined to the rows, so that no text goes through that join.
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", n_lines.alias("n_lines"))
    found = line_dedup.repeated_lines(docs, "doc_id", "text", equal_from=1, into="removed_lines")
    return found.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


SHARDS = 16
#: (verdict, host, path prefix) of op6.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sharding.shard_records(docs, "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.withColumn("law", F.lit("key"))


_WEIGHT = "-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{i}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
_COSTS = [_WEIGHT.format(i=i) for i in range(SHARDS + 1)]

OP2_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS b, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
costs AS (
  SELECT doc_id, md5(coalesce(doc_id::VARCHAR, '')) AS digest, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
    [{", ".join(_COSTS)}] AS w
  FROM documents, tab),
chosen AS (SELECT *, (list_position(w[1:{SHARDS}], list_min(w[1:{SHARDS}])) - 1)::INT AS shard, (list_position(w, list_min(w)) - 1)::INT AS grown_shard FROM costs)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM chosen
"""


def held_out() -> Column:
    """The rows that no model learns labels from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model | None:
    learnt = labels.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return toxicity.fit(docs.filter(~held_out()), learnt, "doc_id", "text", "toxic")


TOXIC_AT = 0.3


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), "text", model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out()), "doc_id", "text", "lang")
    return language_id.predict(docs, "doc_id", "text", model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, "text", ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("_site", url_filter.split_url(F.coalesce("url", F.lit("")))[0])
    out = html_extract.extract(pages, "page_id", "url", "_site", "html")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


#: A conversation that holds the template's own strings.
CONTROL = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    found = chat_format.windows(rows.unionByName(more), "conv_id", "turn", "role", "text")
    new = F.slice(chat_format.turns_of(F.col("text")), F.col("n_context") + 1, F.col("n_new"))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(chat_format.learnt(F.col("text"), F.col("loss")), "")
    each = found.select("conv_id", "chapter", "window", "n_new", F.length("text").alias("chars"), said.alias("said"), learnt.alias("learnt"))
    whole = each.groupBy("conv_id").agg(F.sum("n_new").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("chapter", "window", "said", "learnt"))).alias("parts"))
    joined = {k: F.array_join(F.col(f"parts.{k}"), "") for k in ("said", "learnt")}
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined["said"], 256).alias("turns_sha256"),
        F.length(joined["learnt"]).cast("long").alias("loss_chars"), F.sha2(joined["learnt"], 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


_B, _H, _C = chat_format.BUDGET, chat_format.HISTORY, chat_format.CHAPTER
_MARKS = r"<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE)\]"
OP11_SQL = rf"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
sized AS (
  SELECT *, row_number() OVER o - 1 AS i, len(regexp_extract_all(text, '{chat_format.TOKEN}')) + 2 AS k,
    length(text) + len(regexp_extract_all(text, '{_MARKS}')) + 4
      + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 13 + length(role) + len(regexp_extract_all(role, '{_MARKS}')) END AS chars
  FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, md5(role || chr(10) || text))),
summed AS (
  SELECT *, sum(k) OVER o - k AS p, sum(chars) OVER o - chars AS q, first_value(role = 'system') OVER o AS sys, first_value(k) OVER o AS k0, first_value(chars) OVER o AS c0
  FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
seen AS (  -- what a window that starts at turn i repeats
  SELECT a.conv_id, a.i, a.k, a.p // {_C} AS chapter, CASE WHEN a.sys AND a.i > 0 THEN a.k0 ELSE 0 END AS beside, CASE WHEN a.sys AND a.i > 0 THEN a.c0 ELSE 0 END AS beside_chars,
    coalesce(max(a.p) - min(b.p), 0) AS again, coalesce(max(a.q) - min(b.q), 0) AS again_chars
  FROM summed a LEFT JOIN summed b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i < a.i AND (b.i > 0 OR NOT a.sys)
    AND a.p - b.p <= least({_H}, {_B} - CASE WHEN a.sys AND a.i > 0 THEN a.k0 ELSE 0 END - a.k)
  GROUP BY a.conv_id, a.i, a.k, a.p, a.sys, a.k0, a.c0),
walk AS (
  SELECT conv_id, i, chapter, ({_B} - k)::BIGINT AS room, true AS opens FROM seen WHERE i = 0
  UNION ALL
  SELECT s.conv_id, s.i, s.chapter, (CASE WHEN s.chapter = w.chapter AND s.k <= w.room THEN w.room - s.k ELSE {_B} - s.beside - s.again - s.k END)::BIGINT, NOT (s.chapter = w.chapter AND s.k <= w.room)
  FROM walk w JOIN seen s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1),
extra AS (SELECT conv_id, sum(3 + beside_chars + again_chars) AS chars FROM walk JOIN seen USING (conv_id, i) WHERE opens GROUP BY conv_id),
whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS learnt, sum(chars) AS chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, (whole.chars + extra.chars)::BIGINT AS formatted_chars
FROM whole JOIN extra USING (conv_id)
"""


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, centroids = sort_means.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return sort_means.report(done, centroids, "vec_id")


def _round_sql(r: int) -> str:
    """Assignment to the centroids c{r} and the centroids after it."""
    return f"""
g{r} AS (SELECT x.id, c.c AS cluster, sum((x.x - c.x) * (x.x - c.x)) AS distance FROM xs x JOIN c{r} c USING (d) GROUP BY ALL),
a{r} AS (SELECT id, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM g{r} GROUP BY id),
c{r + 1} AS (
  SELECT c.c, c.d, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x) AS x
  FROM c{r} c LEFT JOIN (SELECT a.cluster, x.d, sum(x.x) AS s, count(*) AS n FROM a{r} a JOIN xs x USING (id) GROUP BY ALL) s ON s.cluster = c.c AND s.d = c.d)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
xs AS (SELECT id, unnest(x) AS x, unnest(range(64)) AS d FROM kept),
seeds AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT x, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, x LIMIT 16)),
c0 AS (SELECT c, unnest(range(64)) AS d, unnest(x) AS x FROM seeds),{",".join(_round_sql(r) for r in range(4))},
named AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT k.vec_id, a.cluster::INT AS cluster, a.distance::BIGINT AS distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(a.distance) OVER ()::BIGINT AS inertia, n.centroid_sha256
FROM a3 a JOIN kept k USING (id) JOIN named n ON n.c = a.cluster
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_bpe": op7_bpe,
    "op8_language_id": op8_language_id,
    "op9_near_dedup": op9_near_dedup,
    "op10_ann": op10_ann,
    "op11_chat_format": op11_chat_format,
    "op12_sort_means": op12_sort_means,
    "op13_whitening": op13_whitening,
}
SQL = {"op2_sharding": OP2_SQL, "op11_chat_format": OP11_SQL, "op12_sort_means": OP12_SQL}
