"""Queries over the corpus tables: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import (
    audit,
    decontamination,
    jaccard,
    mixing,
    onehash,
    pii,
    preferences,
    quality,
    resampling,
    revisits,
    substrings,
    toxicity,
    vectors,
)

# Secret of the surrogates; a deployment brings its own.
KEY = b"corpus key"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_pii_surrogates(spark, sf):
    return pii.replace_entities(table(spark, sf, "documents").select("doc_id", "text"), KEY)


def archive_records(pages: DataFrame) -> DataFrame:
    """Records of an archive derived from pages: each page is captured, and revisited 1,000 seconds later
    under another spelling of its URL. Some revisits name a changed entity tag, some only a date or nothing."""
    page = pages.select("page_id", "url", F.md5("html").alias("digest"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), F.pmod("page_id", F.lit(30)).cast("string"))
    response = page.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("at"),
        tag.alias("etag"), date.alias("last_modified"), "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Cache-Control"),
                     F.lit("max-age=60")).alias("headers"))
    turn = F.pmod("page_id", F.lit(7))
    spelled = F.when(turn == 1, F.concat("url", F.lit("#again"))).when(
        turn == 2, F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), F.lit("&")).otherwise(
            F.lit("?")), F.lit("utm_campaign=x"))).when(
        turn == 3, F.regexp_replace("url", "^http", "HTTP")).otherwise(F.col("url"))
    revisit = page.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), spelled.alias("url"),
        (F.col("page_id") + 1000).alias("at"),
        F.when(turn == 4, F.lit('"changed"')).when(turn < 4, F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(turn < 6, date).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("Date"),
                     (F.col("page_id") + 1000).cast("string")).alias("headers"))
    return response.unionByName(revisit)


@query
def op2_revisits(spark, sf):
    resolved = revisits.resolve_revisits(archive_records(table(spark, sf, "pages")))
    return resolved.withColumn("headers", F.array_join(F.transform(
        "headers", lambda e: F.concat(e["name"], F.lit(": "), e["value"])), "\n"))


ORACLES["op2_revisits"] = r"""
WITH page AS (SELECT page_id, url, md5(html) AS digest, '"' || substr(md5(html), 1, 16) || '"' AS tag,
                     'day ' || (page_id % 30) AS day FROM pages),
records AS (
    SELECT page_id * 2 AS record_id, 'response' AS kind, url, page_id AS ts, tag AS etag, day AS last_modified, digest
    FROM page
    UNION ALL
    SELECT page_id * 2 + 1, 'revisit',
           CASE page_id % 7 WHEN 1 THEN url || '#again'
                WHEN 2 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=x'
                WHEN 3 THEN regexp_replace(url, '^http', 'HTTP') ELSE url END,
           page_id + 1000, CASE WHEN page_id % 7 = 4 THEN '"changed"' WHEN page_id % 7 < 4 THEN 'W/' || tag END,
           CASE WHEN page_id % 7 < 6 THEN day END, NULL
    FROM page),
bare AS (SELECT *, trim(regexp_replace(url, '#.*$', '')) AS u FROM records),
cut AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) AS head FROM bare),
parts AS (
    SELECT *, regexp_replace(regexp_extract(substr(u, length(head) + 1), '^([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(substr(u, length(head) + 1), '^[^?]*\?(.*)$', 1), '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)'))) AS params
    FROM cut),
named AS (
    SELECT record_id, kind, ts, etag, last_modified, digest,
           regexp_replace(regexp_replace(head, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || path
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key
    FROM parts),
best AS (
    SELECT r.record_id, r.key, r.ts, r.etag, r.last_modified, max(struct_pack(ts := o.ts, record_id := o.record_id)) AS old
    FROM named r LEFT JOIN named o ON o.kind = 'response' AND o.key = r.key AND o.ts < r.ts
    WHERE r.kind = 'revisit' GROUP BY ALL),
judged AS (
    SELECT b.*, o.record_id AS refers_to, o.digest AS old_digest, o.etag AS old_tag,
           CASE WHEN o.record_id IS NULL THEN 'no earlier response'
                WHEN regexp_replace(b.etag, '^W/', '') <> o.etag THEN 'etag differs'
                WHEN b.last_modified <> o.last_modified THEN 'last_modified differs'
                WHEN b.etag IS NOT NULL OR b.last_modified IS NOT NULL THEN 'resolved' ELSE 'unverified' END AS verdict
    FROM best b LEFT JOIN named o ON o.kind = 'response' AND o.record_id = b.old.record_id)
SELECT record_id, key AS url, ts AS "at", refers_to, verdict, CASE WHEN verdict = 'resolved' THEN old_digest END AS digest,
       CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10)
            || 'date: ' || ts || chr(10) || 'etag: ' || old_tag END AS headers
FROM judged
"""


@query
def op3_toxicity(spark, sf):
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_decontamination(spark, sf):
    return decontamination.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_mix(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"))


def rival_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations derived as the rejected side: from a turn that depends on conv_id on, each goes on
    with the turns of the next conversation."""
    start = F.pmod("conv_id", F.lit(4)) + 1
    own = conversations.select("conv_id", "turn", "role", "text")
    other = own.withColumn("conv_id", F.col("conv_id") - 1)
    return own.where(F.col("turn") < start).unionByName(other.where(F.col("turn") >= start))


@query
def op6_preferences(spark, sf):
    turns = table(spark, sf, "conversations")
    pairs = preferences.format_preferences(turns, rival_conversations(turns))
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat(
        s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
        for c in ("chosen_spans", "rejected_spans")}
    return pairs.withColumns(spans)


ORACLES["op6_preferences"] = r"""
WITH c AS (SELECT conv_id, turn, min(struct_pack(role := role, text := text)) AS t FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, turn, min(t) AS t FROM (
        SELECT * FROM c WHERE turn < (conv_id % 4) + 1
        UNION ALL SELECT conv_id - 1, turn, t FROM c WHERE turn >= ((conv_id - 1) % 4) + 1) GROUP BY ALL),
both_sides AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.t AS c, r.t AS r
               FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn),
ends AS (SELECT conv_id, min(turn) FILTER (WHERE c IS DISTINCT FROM r) AS cut FROM both_sides GROUP BY conv_id
         HAVING count(c) > 0 AND count(r) > 0),
placed AS (SELECT b.*, cut IS NULL OR turn < cut AS common FROM both_sides b JOIN ends USING (conv_id)),
pieces AS (
    SELECT conv_id, turn, common, side, t.role AS role,
           length('<|im_start|>' || regexp_replace(coalesce(t.role, ''), '<(\\*)\|', '<\\\1|', 'g') || chr(10)) AS head,
           '<|im_start|>' || regexp_replace(coalesce(t.role, ''), '<(\\*)\|', '<\\\1|', 'g') || chr(10) || regexp_replace(coalesce(t.text, ''), '<(\\*)\|', '<\\\1|', 'g')
           || '<|im_end|>' || chr(10) AS piece
    FROM (SELECT conv_id, turn, common, 'c' AS side, c AS t FROM placed
          UNION ALL SELECT conv_id, turn, common, 'r', r FROM placed) WHERE t IS NOT NULL),
spans AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, common, side ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pieces)
SELECT conv_id, (count(*) FILTER (WHERE side = 'c' AND common))::INTEGER AS prefix_turns,
       coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE side = 'c' AND common), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE side = 'c' AND NOT common), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY turn) FILTER (WHERE side = 'r' AND NOT common), '') AS rejected,
       coalesce(string_agg((start + head) || '-' || (start + length(piece) - 1), ',' ORDER BY turn)
           FILTER (WHERE side = 'c' AND NOT common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((start + head) || '-' || (start + length(piece) - 1), ',' ORDER BY turn)
           FILTER (WHERE side = 'r' AND NOT common AND role = 'assistant'), '') AS rejected_spans
FROM spans GROUP BY conv_id
"""


@query
def op7_nearest(spark, sf):
    found = vectors.usable(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return vectors.search(found, found.where("vec_id % 50 = 0"), k=5)


@query
def op8_substring_dedup(spark, sf):
    return substrings.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op9_quality(spark, sf):
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_jaccard_join(spark, sf):
    return jaccard.similar_groups(table(spark, sf, "documents"))


@query
def op11_importance_resampling(spark, sf):
    return resampling.importance_sample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query
def op12_minhash_dedup(spark, sf):
    return onehash.near_duplicates(table(spark, sf, "documents"))


ORACLES["op12_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
           ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
    FROM words),
classes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT node, n, unnest(s) AS shingle FROM classes),
common AS (
    SELECT a.node AS a, b.node AS b, count(*) AS both_have, any_value(a.n) AS an, any_value(b.n) AS bn
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node < b.node
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.node, b.node),
links AS (SELECT a, b FROM common WHERE 100 * both_have >= 80 * (an + bn - both_have)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT node, node FROM classes UNION SELECT r.node, s.b FROM reach r JOIN sides s ON r.other = s.a),
component AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT x.doc_id, len(x.s)::BIGINT AS n_shingles, coalesce(m.low, x.doc_id) AS component_id,
       x.doc_id = coalesce(m.low, x.doc_id) AS kept
FROM sets x LEFT JOIN classes c ON c.s = x.s LEFT JOIN component m ON m.node = c.node
"""


@query
def op13_filter_audit(spark, sf):
    return audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM texts),
fails AS (
    SELECT doc_id, part, concat(
        CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > low THEN 'E' END) AS failed FROM words),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
          FROM labels GROUP BY doc_id),
counted AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
            FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || letter FROM orders, letters WHERE NOT contains(filter_order, letter)),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5),
each AS (
    SELECT c.*, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS letter,
           contains(failed, substr(s.filter_order, s.step, 1)) AS here,
           regexp_matches(substr(s.filter_order, 1, s.step - 1), '[' || failed || 'x]') AS earlier
    FROM counted c, steps s),
summed AS (
    SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept,
           coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant,
           coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
           coalesce(sum(g) FILTER (here AND NOT earlier), 0) AS good_lost,
           coalesce(sum(x) FILTER (here AND NOT earlier), 0) AS toxic_lost
    FROM each GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""
