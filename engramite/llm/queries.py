"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramite.llm import cotrain, decontam, divergence, langid, matroska, neardup, packing, pii, runs, secrets, suffixtree, toxicity, urlgraph
from engramite.llm.common import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(read_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.filter_urls(read_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_as_media(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.audit_runs(read_table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score_texts(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_language_id, op3_url_filters, op4_packing, op5_secrets, op6_decontamination, op7_near_duplicates, op8_quality, op9_matroska, op10_toxicity, op11_divergence, op12_periodic_runs, op13_lm_scoring)}

_LOWER = f"translate(text, '{urlgraph.UPPER}', '{urlgraph.LOWER}')"

#: Windows of items as joined words; a document's words are hit where a window's text equals an item's.
OP6_SQL = rf"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT r, i, size, array_to_string(w[i + 1 : i + size], ' ') AS k
  FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM doc, sizes WHERE len(w) >= size)),
found AS (SELECT d.r, d.i, d.size, x.item_id FROM doc_windows d JOIN item_windows x ON d.size = x.size AND d.k = x.k),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item_id::varchar AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n, 0)::bigint AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

#: All pairs that share a shingle, by exact set sizes.
OP7_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM doc WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM both_ways UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON r.b = e.x),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM doc LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id"""

#: The full grid of groups and kept terms, and every pair of sources over all kept terms.
OP11_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM word GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total)::hugeint AS size FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM doc),
grid AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size FROM grid),
share AS MATERIALIZED (
  SELECT s.lang, s.source, s.term, s.n, (1 + 1000000000::hugeint * (s.n + 2) // (s.size + 2 * l.v))::bigint AS p, (1 + 1000000000::hugeint * (s.total + 2) // (l.size + 2 * l.v))::bigint AS q
  FROM sized s JOIN langs l USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::bigint AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint FROM share WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM every) WHERE part = 'pair' OR rank <= 10"""

ORACLES = {"op11_divergence": OP11_SQL, "op3_url_filters": urlgraph.oracle_sql(), "op6_decontamination": OP6_SQL, "op7_near_duplicates": OP7_SQL}
