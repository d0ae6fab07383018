"""Queries of the corpus operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.brown import brown_scores
from cellweave.llm.common import table
from cellweave.llm.exact_dedup import exact_dedup
from cellweave.llm.html_text import extract_text
from cellweave.llm.lexical import lexical_search
from cellweave.llm.mixing import mix
from cellweave.llm.near_dedup import near_dedup
from cellweave.llm.ownership import KINDS as SECRET_KINDS
from cellweave.llm.ownership import secrets
from cellweave.llm.packing import pack
from cellweave.llm.pii import personal_data
from cellweave.llm.postings import nearest_neighbours
from cellweave.llm.runs import periodic_runs, planted, strongest
from cellweave.llm.sharding import shard_documents
from cellweave.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op9_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL["op10_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op3_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


@query
def op1_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(table(spark, sf_dir, "documents"))


@query
def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op2_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op11_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(keep) -> Column:
        return F.array_join(F.transform(F.filter("spans", keep), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(keep) -> Column:
        return F.size(F.filter("spans", keep)).cast("long")

    def of(kind: str):
        return lambda x: x["base"] & (x["kind"] == kind)

    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(of(k)).alias(f"n_{k}") for k in SECRET_KINDS],
        F.sha2(listed(lambda x: x["base"]), 256).alias("base_sha256"), listed(lambda x: F.lit(True)).alias("spans"),
        count(lambda x: ~x["base"]).alias("n_added"), count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: x["copied"]).alias("n_copied"))


SQL["op11_ownership_secrets"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, 'unknown') AS owner, coalesce(text, '') AS text,
                    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS repo FROM documents),
form(kind, place, base, least, pattern) AS (VALUES
  ('assign', 1, true, 12, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 2, true, 18, '((AKIA[A-Z0-9]+))'),
  ('hex', 3, true, 16, '(([0-9a-f]+))'),
  ('assign', 1, false, 12, '([pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD]|[pP][hH][rR][aA][sS][eE]|[cC][oO][dD][eE])?|[pP][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]|[aA][uU][tT][hH]|[bB][eE][aA][rR][eE][rR]|[cC][rR][eE][dD][eE][nN][tT][iI][aA][lL]|[pP][rR][iI][vV][aA][tT][eE]_?[kK][eE][yY]|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY]|[sS][iI][gG][nN][aA][tT][uU][rR][eE])[A-Za-z0-9_]{0,24}["'']?\x20*(?:=>|:=|==|=|:)\x20*["'']?([A-Za-z0-9+/_.=~!@#$%^&*-]{12,})'),
  ('access', 2, false, 0, '(((?:ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))'),
  ('hex', 3, false, 0, '(([0-9A-Fa-f]{32,}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}))')),
hit AS (SELECT r, owner, repo, kind, place, base, least, regexp_extract_all(text, pattern) AS m, regexp_extract_all(text, pattern, 2) AS v,
               string_split_regex(text, pattern) AS gaps FROM doc, form WHERE regexp_matches(text, pattern)),
one AS (SELECT r, owner, repo, kind, place, base, least, i, m[i] AS m, v[i] AS value,
               list_sum(list_transform(m[:i], lambda x: length(x))) + list_sum(list_transform(gaps[:i], lambda x: length(x))) AS "end"
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit)),
span AS (SELECT r, owner, repo, kind, place, base, CAST("end" - length(m) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", value
         FROM one WHERE length(value) >= least),
free AS (SELECT * FROM span x WHERE base OR NOT EXISTS (
  SELECT 1 FROM span y WHERE y.base AND y.r = x.r AND y.kind = x.kind AND y.start < x."end" AND x.start < y."end")),
held AS (SELECT lower(value) AS hash, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM free GROUP BY ALL),
judged AS (SELECT free.*, least(owners, repos) >= 3 AS copied,
                  least(owners, repos) < 3 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
                  AND len(list_distinct(string_split(value, ''))) >= 8
                  AND NOT regexp_matches(value, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|12345678|abcdefgh|00000000') AS live
           FROM free JOIN held ON lower(value) = hash),
listed AS (
  SELECT r, string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, place) FILTER (base) AS base_list,
         string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, place) AS spans,
         count(*) FILTER (base AND kind = 'assign') AS n_assign, count(*) FILTER (base AND kind = 'access') AS n_access,
         count(*) FILTER (base AND kind = 'hex') AS n_hex, count(*) FILTER (NOT base) AS n_added, count(*) FILTER (live) AS n_live,
         count(*) FILTER (copied) AS n_copied
  FROM judged WHERE base OR live GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_list, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM doc LEFT JOIN listed USING (r)
"""


@query
def op12_frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest())
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_frequency_split_runs"] = r"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                        lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS h
  FROM documents),
place AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM given),
word AS (
  SELECT r, n, i, w[1 + CASE WHEN a IS NOT NULL AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM place)),
often AS (SELECT * FROM word QUALIFY count(*) OVER (PARTITION BY r, word) >= 3),
pair AS (SELECT x.r, y.i - x.i AS q, x.i FROM often x JOIN often y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
streak AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pair),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS size FROM streak GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT * FROM stretch x WHERE NOT EXISTS (
  SELECT 1 FROM stretch y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.size >= x.s + x.size)),
best AS (SELECT * FROM run x WHERE NOT EXISTS (
  SELECT 1 FROM run y WHERE y.r = x.r AND (y.size * x.q > x.size * y.q OR (y.size * x.q = x.size * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))))),
listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', size, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM word x
  WHERE NOT EXISTS (SELECT 1 FROM run y WHERE y.r = x.r AND x.i >= y.s + y.q AND x.i < y.s + y.size) GROUP BY r)
SELECT g.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, b.size AS length, b.q AS period, 1000 * b.size // b.q AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM given g LEFT JOIN listed l USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept k USING (r)
"""

SQL["op13_interval_search"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM doc WHERE len(terms) > 0),
ask AS (
  SELECT slot, item_id, term, count(*) AS times
  FROM (SELECT slot, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS slot, item_id, text FROM benchmark)) GROUP BY slot, item_id, term),
post AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc)
         WHERE term IN (SELECT term FROM ask) GROUP BY r, doc_id, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS v
           FROM post JOIN weight USING (term), total),
scored AS (SELECT slot, item_id, r, doc_id, CAST(sum(times * v) AS BIGINT) AS score
           FROM ask JOIN impact USING (term) GROUP BY slot, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY slot ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
