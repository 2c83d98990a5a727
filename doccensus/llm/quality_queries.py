"""Queries of the quality classifier, licence scan and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccensus.llm import licences, ranking, rules
from doccensus.llm.shared import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _held_out(frame: DataFrame):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = ranking.fit(docs, labels.filter(~_held_out(labels)))
    scored = ranking.score(docs, model)
    return scored.select("doc_id", F.coalesce(_held_out(scored), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir, "doc_id", "text"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged_columns(rules.judge(documents(spark, sf_dir, "doc_id", "text", "lang"), ["doc_id"]), "doc_id")
    return judged.drop("char_distance", "word_distance")


QUERIES |= {"op4_quality": op4_quality, "op5_licences": op5_licences, "op6_rules": op6_rules}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PAIRS = r"""list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])"""
_WORDS = r"""string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), ' ')"""

_LONG = [(t, name, len(licences._words(text)), text) for t, (name, text) in enumerate(licences.TEMPLATES)]
_PLACES = [(t, word, p) for t, _, _, text in _LONG for word, p in licences.key_places(text)]

ORACLE["op5_licences"] = f"""
WITH lines AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL),
segments AS (
  SELECT rid, doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS segment, unnest(string_split(text, chr(10))) AS s FROM lines
  UNION ALL SELECT rid, doc_id, -1, text FROM lines WHERE contains(text, chr(10))),
found AS (SELECT rid, doc_id, segment, {_PAIRS} AS a FROM (SELECT *, {_WORDS.format("s")} AS ws FROM segments)),
known AS (
  SELECT licence, {_PAIRS} AS b FROM (
    SELECT licence, {_WORDS.format("t")} AS ws FROM (VALUES {", ".join(f"({_literal(n)}, {_literal(t)})" for n, t in licences.TEMPLATES)}) v(licence, t))),
hits AS (
  SELECT rid, doc_id, segment, licence, len(a)::INT AS n_bigrams, len(b)::INT AS n_template, len(list_intersect(a, b))::INT AS shared
  FROM found JOIN known ON len(a) * {licences.MIN_DICE} <= len(b) * {200 - licences.MIN_DICE} AND len(b) * {licences.MIN_DICE} <= len(a) * {200 - licences.MIN_DICE}),
lined AS (
  SELECT * FROM hits WHERE 200 * shared >= {licences.MIN_DICE} * (n_bigrams + n_template)
  QUALIFY row_number() OVER (PARTITION BY rid, segment ORDER BY 2 * shared / (n_bigrams + n_template) DESC, licence, n_template) = 1),
whole AS (SELECT rid, doc_id, {_WORDS.format("text")} AS ws FROM lines),
template AS (
  SELECT t, licence, n, {_PAIRS} AS b FROM (
    SELECT t, licence, n, {_WORDS.format("x")} AS ws FROM (VALUES {", ".join(f"({t}, {_literal(name)}, {n}, {_literal(text)})" for t, name, n, text in _LONG)}) v(t, licence, n, x))),
place AS (SELECT * FROM (VALUES {", ".join(f"({t}, {_literal(word)}, {p})" for t, word, p in _PLACES)}) v(t, word, p)),
laid AS (
  SELECT DISTINCT rid, t, greatest(i - p, 0) AS start
  FROM (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM whole) JOIN place USING (word)),
cut AS (
  SELECT rid, doc_id, start, licence, n, b, {_PAIRS} AS a FROM (
    SELECT rid, doc_id, start, licence, n, b, ws[start + 1 : start + n] AS ws FROM laid JOIN whole USING (rid) JOIN template USING (t))),
near AS (
  SELECT rid, doc_id, start, licence, n, len(a)::INT AS n_bigrams, len(b)::INT AS n_template, len(list_intersect(a, b))::INT AS shared FROM cut),
best AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n_bigrams + n_template - 3 * shared, start, licence, n_template, shared, n_bigrams, n) AS rank
  FROM (
    SELECT * FROM near WHERE 200 * shared >= {licences.MIN_DICE} * (n_bigrams + n_template)
    QUALIFY row_number() OVER (PARTITION BY rid, licence ORDER BY n_bigrams + n_template - 3 * shared, start, n_template, shared, n_bigrams, n) = 1)),
inside AS (
  SELECT * FROM best h WHERE NOT EXISTS (
    SELECT 1 FROM best g WHERE g.rid = h.rid AND g.rank < h.rank AND g.start < h.start + h.n AND h.start < g.start + g.n))
SELECT doc_id, segment, NULL::INT AS start, licence, n_bigrams, n_template, shared, 2 * shared / (n_bigrams + n_template) AS dice FROM lined
UNION ALL SELECT doc_id, -2, start, licence, n_bigrams, n_template, shared, 2 * shared / (n_bigrams + n_template) FROM inside
"""

_CHARS = ", ".join(f"length(t) - length(regexp_replace(t, {_literal('[' + c + ']+')}, '', 'g'))" for c in rules.CHAR_CLASSES)
_REST = f"length(regexp_replace(t, {_literal('[' + ''.join(rules.CHAR_CLASSES) + ']+')}, '', 'g'))"
_LANGS = ", ".join(map(_literal, rules.LANGUAGES))

ORACLE["op6_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IN ({_LANGS}) THEN lang ELSE 'other' END AS grp, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    list_filter(string_split(regexp_replace(lower(t), '\P{{L}}+', ' ', 'g'), ' '), lambda x: x <> '') AS runs
  FROM d),
windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s WHERE len(ws) >= 3)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
base AS (
  SELECT s.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(length(list_aggregate(ws, 'string_agg', '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN covered USING (rid)),
histogram AS (
  SELECT rid, grp, 'c' AS kind, unnest(range({len(rules.CHAR_CLASSES) + 1})) AS b, unnest([{_CHARS}, {_REST}]) AS x FROM s
  UNION ALL
  SELECT s.rid, s.grp, 'w', w.b, count(r.run) FROM s CROSS JOIN (
    SELECT unnest(range({len(rules.WORDS)})) AS b, unnest([{", ".join(map(_literal, rules.WORDS))}]) AS word) w
  LEFT JOIN (SELECT rid, unnest(runs) AS run FROM s) r ON r.rid = s.rid AND r.run = w.word GROUP BY s.rid, s.grp, w.b
  UNION ALL
  SELECT rid, grp, 'w', {len(rules.WORDS)}, len(list_filter(runs, lambda x: NOT list_contains([{", ".join(map(_literal, rules.WORDS))}], x))) FROM s),
sized AS (SELECT *, sum(x) OVER (PARTITION BY rid, kind) AS n FROM histogram),
sound AS (
  SELECT min(s.rid) AS rid FROM s JOIN base USING (rid)
  WHERE n_words >= {rules.MIN_WORDS} AND 100 * n_repeat_words <= {rules.MAX_REPEATED_PERCENT} * n_words GROUP BY s.grp, s.t),
reference AS (
  SELECT grp, kind, b, sum(CASE WHEN n > 0 THEN floor(x * {rules._SCALE} / n) ELSE 0 END) AS q FROM sized WHERE rid IN (SELECT rid FROM sound) GROUP BY ALL),
both_ AS (
  SELECT rid, kind, n, x / n AS p, q / sum(q) OVER (PARTITION BY rid, kind) AS q FROM sized JOIN reference USING (grp, kind, b)),
far AS (
  SELECT rid, kind, any_value(n) AS n, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM both_ WHERE n > 0 GROUP BY ALL),
bad AS (
  SELECT DISTINCT rid FROM far WHERE (kind = 'c' AND n >= {rules.MIN_CHARS} AND js > {rules.MAX_CHAR_DISTANCE}) OR (kind = 'w' AND n >= {rules.MIN_COMMON} AND js > {rules.MAX_WORD_DISTANCE}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words) AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM base
"""
