"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..functions.text import let
from . import (
    byte_pairs, chat, divergence, exact_dedup, jaccard, language_id, packing, periodic_runs, pieces, quality,
    sharding, suffix_dedup, url_filter,
)
from .common import ASCII_SPACE, ship_package, table, text_or_empty, utf8

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _id_digests(decoded: DataFrame, data: Column) -> DataFrame:
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(utf8(listed), 256).alias("ids_sha256"), F.sha2(data, 256).alias("decoded_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = pieces.decode_pieces(pieces.encode_pieces(table(spark, sf_dir, "documents")))
    return _id_digests(decoded, utf8(F.col("decoded")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_language(docs, language_id.fit_language_model(docs))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, that says nothing but the marks of another template."""
    said = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], schema)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(turns))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_pairs.decode_bytes(byte_pairs.encode_bytes(table(spark, sf_dir, "documents")))
    return _id_digests(decoded, F.col("decoded"))


def _planted(key: Column, text: Column) -> Column:
    """One text in ten made periodic from one of its words on; which, where and how by the checksum of its key."""
    h = F.crc32(utf8(key.cast("string")))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, ASCII_SPACE + "+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(w.alias("w"), a.alias("a"), p.alias("p")), lambda v: F.array_join(
            F.transform(v["w"], lambda x, i: F.when(i < v["a"], x).otherwise(
                F.get(v["w"], (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))), " "))

    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, periodic)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", _planted(F.col("doc_id"), text_or_empty("text")).alias("text"))
    found = periodic_runs.periodic_runs(planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    ended = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"),
        F.col("_best.n").alias("length"), (-F.col("_best.p")).alias("period"),
        F.floor(1000 * F.col("_best.n") / -F.col("_best.p")).alias("exponent_milli"),
        F.sha2(utf8(ended), 256).alias("runs_sha256"),
        F.sha2(utf8(F.col("collapsed")), 256).alias("collapsed_sha256"), "n_words")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    return run


QUERIES: dict[str, Query] = {f.__name__: _shipped(f) for f in (
    op1_suffix_dedup, op2_quality_rules, op3_packing, op4_sentencepiece, op5_language_id,
    op6_jaccard_join, op7_url_filters, op8_sharding, op9_exact_dedup, op10_chat_formatting,
    op11_byte_pairs, op12_periodic_runs, op13_source_divergence, pipeline)}

_URL = r"'(?s)\A.*?://([^/?#]*)([^?#]*)'"
_KEY = rf"""CASE WHEN contains({{u}}, '://') THEN
  translate(regexp_extract({{u}}, {_URL}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || regexp_replace(regexp_extract({{u}}, {_URL}, 2), '/$', '')
  || regexp_extract({{u}}, '(?s)\A.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) ELSE {{u}} END"""
_RULES = ", ".join(
    f"('{action}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')"
    for action, rule in url_filter.RULES)

_VALUES = ", ".join(
    f"('{m.name}', {m.scale} * {m.top} // greatest({m.per}, 1))" for m in quality.MEASURES)
_CHANCES = ", ".join(
    f"('{m.name}', {m.chance}, {m.per}, {'true' if m.both_sides else 'false'})" for m in quality.MEASURES)
_SHARES = ", ".join(
    f"min(CASE WHEN {of} * upto >= {share} * total THEN b END) AS {q}" for q, (share, of) in quality.QUANTILES.items())


ORACLES: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
y AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM y) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines FROM l LEFT JOIN r USING (doc_id)),
d AS (SELECT *, n_words < {quality.MIN_WORDS}
  OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
v AS (SELECT d.*, m.measure, m.v, (m.v >> greatest(length(bin(m.v)) - {quality.BUCKET_BITS}, 0)::INT)
  << greatest(length(bin(m.v)) - {quality.BUCKET_BITS}, 0)::INT AS b
  FROM d, LATERAL (VALUES {_VALUES}) m(measure, v)),
s AS (SELECT lang, source, measure, b, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
e AS (SELECT measure, b, n, sum(n) OVER (PARTITION BY measure) AS total
  FROM (SELECT measure, b, sum(n) AS n FROM s GROUP BY ALL)),
u AS (SELECT lang, measure, b, n, sum(n) OVER (PARTITION BY lang, measure) AS total
  FROM (SELECT lang, measure, b, sum(n) AS n FROM s GROUP BY ALL)),
f AS (SELECT DISTINCT lang, source, measure FROM s),
z AS (SELECT lang, source, measure, b, {quality.PART} * n AS n FROM s
  UNION ALL SELECT f.lang, source, f.measure, b, {quality.PRIOR * quality.PART} * n // (total + {quality.PRIOR})
  FROM f JOIN u ON f.lang IS NOT DISTINCT FROM u.lang AND f.measure = u.measure
  UNION ALL SELECT f.lang, source, f.measure, e.b, {quality.PRIOR ** 2 * quality.PART} * e.n // e.total // (x.total + {quality.PRIOR})
  FROM f JOIN e USING (measure) JOIN (SELECT DISTINCT lang, measure, total FROM u) x
    ON f.lang IS NOT DISTINCT FROM x.lang AND f.measure = x.measure),
q AS (SELECT lang, source, measure, {_SHARES} FROM (SELECT lang, source, measure, b,
  sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto,
  sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM z) GROUP BY ALL),
h AS (SELECT doc_id, v, q1, q3, both_sides, greatest({quality.FENCE} * (q3 - q1), {quality.FENCE} * (q7 - q3),
  floor({quality.FENCE} * chance / sqrt(least(greatest(per, 1), {quality.ALIKE})::DOUBLE))::BIGINT) AS reach
  FROM (SELECT v.*, q1, q3, q7 FROM v JOIN q
    ON v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source AND v.measure = q.measure) x,
  LATERAL (VALUES {_CHANCES}) k(name, chance, per, both_sides) WHERE name = measure),
k AS (SELECT doc_id, bool_and(v BETWEEN CASE WHEN both_sides THEN q1 - reach ELSE 0 END AND q3 + reach) AS fits
  FROM h GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(fits, false) AS kept, n_lines FROM d LEFT JOIN k USING (doc_id)""",
    # The supplied pages hold no redirect or canonical link, so equal addresses are the only aliases.
    "op7_url_filters": f"""
WITH rules(action, rule, h, p) AS (VALUES {_RULES}),
p AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, {_URL}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, {_URL}, 2), '') AS path, {_KEY.format(u="url")} AS alias_of FROM pages),
fit AS (SELECT DISTINCT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM (SELECT DISTINCT host, path FROM p), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
j AS (SELECT p.*, rule, action FROM p LEFT JOIN fit USING (host, path)),
bad AS (SELECT DISTINCT alias_of FROM j WHERE action = 'block')
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN alias_of IN (SELECT alias_of FROM bad) THEN 'block' END, 'allow') AS verdict, alias_of
FROM j""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size, (min(struct_pack(c := -c, i := doc_id))).i AS keep_id FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, sha256(n.t) AS text_sha256, doc_id = keep_id AS kept FROM n JOIN g USING (t)""",
    "op10_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, length('<s>[ROLE][/ROLE]</s>') + length(role) + length(text)
  + len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*(?:/?s>|/?(?:ROLE|INST)\]|</?SYS>>)')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars FROM t GROUP BY conv_id""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS cl FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(cl) AS nl FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c,
  1 + ({divergence.SHARES}::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(n, 0) + 2 * v) AS p,
  1 + ({divergence.SHARES}::HUGEINT * (cl + 2)) // (nl + 2 * v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b USING (lang) LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}""",
}
