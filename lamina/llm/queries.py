"""The corpus operators' queries with production parameters, and SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import bpe_codec, decontaminate, filter_audit, knn_quality, label_shards, prefix_hash, recurrent_lm, simhash_dedup, source_divergence, suffix_merge, token_counts, toxic_cnn, url_lists
from lamina.session import shared_root, table


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the application's checkpoint folder, which driver and executors share and which ends with the application."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log probabilities of every document, learned from those that are not held out."""
    held_out = knn_quality.crc_remainder("doc_id", 10) == 0
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"), held_out, shared_folder(spark, "lm"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document through the digest cache that the setting lamina.token.cache names, or a new one where it is unset."""
    cache = spark.conf.get("lamina.token.cache", None) or shared_folder(spark, "token-counts")
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), cache, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op3_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return prefix_hash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    held_out = knn_quality.crc_remainder("doc_id", 3) == 1
    found = knn_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with copies of benchmark items, by rare n-gram seeds and local alignment."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 4-word shingles and the components of links at up to 4 bits."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards, equal texts together where the quotas allow it."""
    return label_shards.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op8_toxic_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    held_out = knn_quality.crc_remainder("doc_id", 5) == 0
    found = toxic_cnn.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and a fetch date for every page: a day of 2024 told from its number."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")).alias("fetched"))


def list_log(pages: DataFrame) -> DataFrame:
    """A dated log of four lists over the pages' hosts and their parent domains, told from digests of the names."""
    names = pages.select(url_lists.host(F.col("url")).alias("host")).filter("host <> ''").distinct()
    names = names.select(F.explode(url_lists.parents(F.col("host"))).alias("pattern")).filter("instr(pattern, '.') > 0").distinct()
    turns = names.select("pattern", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("turn"))
    part = lambda at, digits: F.conv(F.substring("digest", at, digits), 16, 10).cast("int")
    turns = turns.withColumn("digest", F.md5(F.concat_ws("#", "pattern", F.col("turn").cast("string")).cast("binary")))
    return turns.filter(part(1, 2) < 96).select(
        F.element_at(F.array(*[F.lit(x) for x in ("adult", "malware", "spam", "trackers")]), part(3, 2) % 4 + 1).alias("list"),
        "pattern",
        F.element_at(F.array(*[F.lit(x) for x in ("block", "allow", "remove", "block")]), part(5, 2) % 4 + 1).alias("action"),
        F.date_add(F.lit("2023-10-01").cast("date"), part(7, 4) % 450).alias("dated"),
    )


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries that held when it was fetched."""
    found = url_lists.evaluate(fetched_pages(spark, sf_dir), list_log(table(spark, sf_dir, "pages")))
    return found.withColumn("fetched", F.col("fetched").cast("string"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes the ids and gives both digests."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that start anywhere else too."""
    return suffix_merge.without_repeats(table(spark, sf_dir, "documents"), length=400)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all pairs of sources of a language, and the terms that stand out in each source."""
    return source_divergence.divergence_audit(table(spark, sf_dir, "documents"), least=3, most=200)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters by language: what each step keeps, removes and shares with the others."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_recurrent_lm": op1_recurrent_lm,
    "op2_token_counts": op2_token_counts,
    "op3_prefix_hash": op3_prefix_hash,
    "op4_knn_quality": op4_knn_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_label_shards": op7_label_shards,
    "op8_toxic_cnn": op8_toxic_cnn,
    "op9_url_lists": op9_url_lists,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_suffix_merge": op11_suffix_merge,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_audit": op13_filter_audit,
}

#: DuckDB's form of url_lists.HOST, of a list of parent domains, and of the log above.
_URL_SQL = r"""
WITH captures AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1), '') AS host,
         (DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER)) AS fetched
  FROM pages),
moments AS (SELECT DISTINCT host, fetched FROM captures WHERE host <> '' AND fetched IS NOT NULL),
asked AS (
  SELECT host, fetched, unnest([array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)]) AS pattern
  FROM moments),
turns AS (
  SELECT pattern, turn, md5(pattern || '#' || turn::VARCHAR) AS digest
  FROM (SELECT DISTINCT pattern FROM asked WHERE contains(pattern, '.')), range(6) t(turn)),
entries AS (
  SELECT ['adult', 'malware', 'spam', 'trackers'][('0x' || digest[3:4])::INT % 4 + 1] AS list, pattern,
         ['block', 'allow', 'remove', 'block'][('0x' || digest[5:6])::INT % 4 + 1] AS action,
         DATE '2023-10-01' + ('0x' || digest[7:10])::INT % 450 AS dated
  FROM turns WHERE ('0x' || digest[1:2])::INT < 96),
log AS (SELECT list, pattern, dated, max(action) AS action FROM entries GROUP BY ALL),
holds AS (
  SELECT list, pattern, action, dated AS valid_from, lead(dated) OVER (PARTITION BY list, pattern ORDER BY dated) AS valid_to FROM log),
said AS (
  SELECT host, fetched, list, max_by(action, length(a.pattern)) AS action
  FROM asked a JOIN holds h ON a.pattern = h.pattern AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
  WHERE action <> 'remove' GROUP BY ALL),
blocked AS (SELECT host, fetched, string_agg(list, ',' ORDER BY list) AS lists FROM said WHERE action = 'block' GROUP BY ALL)
SELECT page_id, c.host, c.fetched::DATE::VARCHAR AS fetched, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists
FROM captures c LEFT JOIN blocked b ON c.host = b.host AND c.fetched = b.fetched
"""

_DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT g.lang, g.source, coalesce(max(v), 0) AS v, coalesce(sum(n), 0) AS total
  FROM groups g LEFT JOIN sizes s ON g.lang = s.lang LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (t.total + t.v) AS HUGEINT) AS p
  FROM totals t JOIN kept k ON t.lang = k.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
whole AS (
  SELECT c.lang, c.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (max(l.total) + max(l.v)) AS HUGEINT) AS q
  FROM counts c JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM totals GROUP BY lang) l ON c.lang = l.lang GROUP BY c.lang, c.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value
  FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM all_pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) t WHERE rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""

_FILTERS_SQL = r"""
WITH least AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY coalesce(text, '')),
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flags AS (
  SELECT d.doc_id, part,
         CAST(len(words) < 100 AS INTEGER)
         + CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER) * 2
         + CAST(100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) AS INTEGER) * 4
         + CAST(regexp_matches(d.text, '[#$%&*|]') AS INTEGER) * 8
         + CAST(d.doc_id > first AS INTEGER) * 16 AS mask,
         CAST(coalesce(quality = 1, false) AS INTEGER) AS good, CAST(coalesce(toxic = 1, false) AS INTEGER) AS toxic
  FROM docs d JOIN least l ON d.text = l.text LEFT JOIN labels b ON d.doc_id = b.doc_id),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON a.bit <> b.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
  JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (
  SELECT filter_order, CAST(s.step AS INTEGER) AS step, bits[s.step] AS bit, CAST(coalesce(list_sum(bits[1:s.step - 1]), 0) AS INTEGER) AS before
  FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, mask),
found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""

ORACLES: dict[str, str] = {"op9_url_lists": _URL_SQL, "op12_source_divergence": _DIVERGENCE_SQL, "op13_filter_audit": _FILTERS_SQL}
