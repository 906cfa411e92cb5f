"""The queries of this subpackage over the given tables, with SQL twins where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, fim, hosts, language, lines, mixing, negatives, positive, quality, search, shards, simhash, wrappers
from tracelake.llm.common import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

_MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
turned AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sources),
weighed AS (SELECT *, turn + 1.0::DOUBLE AS weight, 3 * source_size AS cap FROM turned),
levels AS (
  SELECT cap / weight AS ratio,
         ((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER before, 0))
         / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(level) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, turn, least(CAST(cap AS DOUBLE), coalesce(level * weight, cap)) AS target FROM weighed, level),
started AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.turn, CAST(round(t.target) AS BIGINT) AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, greatest(least(goal - start, size), 0) AS first, greatest(least(goal - start - source_size, size), 0) AS second,
         greatest(least(goal - start - 2 * source_size, size), 0) AS third,
         least(start / target, 1.0::DOUBLE) AS share FROM started)
SELECT doc_id, size, source_size, target, CAST(first + second + third AS BIGINT) AS taken,
       CASE WHEN first + second + third = 0 THEN NULL
            WHEN turn = 0 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share))
            WHEN turn = 1 THEN share
            WHEN 3 * share <= 1.75 THEN 6 * share / (4 + sqrt(16 - 12 * share))
            ELSE 0.5 + 2 * (3 * share - 1.75) / (3 + sqrt(9 - 4 * (3 * share - 1.75))) END AS position
FROM passes"""


@query("op1_mix_sources", _MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


@query("op4_simhash_pigeonring")
def simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_digest(table(spark, sf_dir, "documents"))


def _level_sql(above: str, level: str) -> str:
    """One level of the descent: the node of the least draw below the node chosen before."""
    bits = f"('0x' || substr(md5(a.key || '/{level}/' || t.{level}), 1, 13))::BIGINT"
    nodes = f"SELECT tree, {above} {level}, sum(weight) AS weight FROM shards GROUP BY ALL"
    return f"""
  SELECT a.* EXCLUDE (weight), arg_min(t.{level}, (-ln(({bits} + 0.5) / 4503599627370496) / t.weight, t.{level})) AS {level}
  FROM (SELECT *, 0 AS weight FROM {{}}) a JOIN ({nodes}) t USING (tree{{}}) GROUP BY ALL"""


_SHARD_SQL = f"""
WITH shards AS (
  SELECT tree, shard, shard // 4 AS rack, shard // 8 AS region, 1.0::DOUBLE AS weight
  FROM range(17) AS s(shard), (VALUES ('old'), ('new')) AS v(tree) WHERE shard < 16 OR tree = 'new'),
keys AS (SELECT DISTINCT tree, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents, (VALUES ('old'), ('new')) AS v(tree)),
in_region AS ({_level_sql("", "region").format("keys", "")}),
in_rack AS ({_level_sql("region,", "rack").format("in_region", ", region")}),
in_shard AS ({_level_sql("rack,", "shard").format("in_rack", ", rack")}),
""" + r"""best AS (
  SELECT key, min(region) FILTER (tree = 'old') AS region, min(rack) FILTER (tree = 'old') AS rack,
         min(shard) FILTER (tree = 'old') AS shard, min(shard) FILTER (tree = 'new') AS grown_shard
  FROM in_shard GROUP BY key),
shifts AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)),
digits AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM digits, shifts),
placed AS (
  SELECT d.doc_id, coalesce(strlen(d.text), 0) + 1 AS size, b.* EXCLUDE (key), c.crc
  FROM documents d JOIN best b ON coalesce(CAST(d.doc_id AS VARCHAR), '') = b.key JOIN crcs c ON c.doc_id = d.doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard, CAST(region AS INTEGER) AS region, CAST(rack AS INTEGER) AS rack
FROM placed"""


@query("op6_hash_tree_shards", _SHARD_SQL)
def hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), 16)


@query("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec.of_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), codec, ["doc_id"])


_NEAREST_SQL = """
WITH vecs AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


@query("op2_rotated_code_search", _NEAREST_SQL)
def rotated_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


_QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (SELECT doc_id, p, ws[p:p + 4] AS gram FROM w, unnest(range(1, len(ws) - 3)) AS u(p)),
twice AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS words FROM counted),
steps AS (
  SELECT doc_id, lang, base_failed, m.measure, m.place, CAST(ceil(greatest(0.0::DOUBLE, least(1.0::DOUBLE, m.v)) * 200) AS INTEGER) AS step
  FROM based, unnest([{'measure': 'symbols', 'place': 1, 'v': n_symbols / words}, {'measure': 'dup_lines', 'place': 2, 'v': n_dup_lines * 10 / words},
                      {'measure': 'repeats', 'place': 3, 'v': n_repeat_words / words}, {'measure': 'long_words', 'place': 4, 'v': (word_chars / words - 3) / 17},
                      {'measure': 'short_words', 'place': 5, 'v': (6 - word_chars / words) / 6}]) AS u(m)),
ladder AS (
  SELECT lang, measure, step, sum(quality) AS good, sum(1 - quality) AS poor
  FROM steps JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND NOT base_failed GROUP BY ALL),
cuts AS (
  SELECT l.lang, l.measure, c, sum(good) AS n_good, sum(poor) AS n_poor, coalesce(sum(good) FILTER (step > c), 0) AS k, coalesce(sum(poor) FILTER (step > c), 0) AS hit
  FROM ladder l, range(201) AS r(c) GROUP BY ALL),
tails AS (
  SELECT *, list_sum(list_transform(range(CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
                                                                       + i * ln(0.02::DOUBLE) + (n_good - i) * ln(0.98::DOUBLE)))) AS tail
  FROM cuts WHERE k <= 0.03 * n_good),
gains AS (
  SELECT lang, measure, c, hit / greatest(n_poor, 1) - 10 * k / greatest(n_good, 1) AS gain FROM tails
  WHERE tail <= 0.1 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM ladder)) * 5)),
chosen AS (SELECT lang, measure, c FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, measure ORDER BY gain DESC, c DESC) = 1),
broken AS (
  SELECT s.doc_id, arg_min(s.measure, s.place) AS rule FROM steps s
  JOIN chosen c ON s.lang IS NOT DISTINCT FROM c.lang AND s.measure = c.measure AND s.step > c.c GROUP BY s.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.rule IS NULL AS kept, x.rule
FROM based b LEFT JOIN broken x ON b.doc_id = x.doc_id"""


@query("op3_risk_controlled_quality", _QUALITY_SQL)
def risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_language_filters")
def language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(table(spark, sf_dir, "documents"))


RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_FITTED = """
  SELECT *, least((1 - spread) / spread, worth) AS strength
  FROM {0}, (SELECT least(greatest(coalesce((sum(n * pow(y / n - prior, 2) / (prior * (1 - prior))) FILTER (n > 0) - count(*) FILTER (n > 0))
                                            / nullif(sum(n - 1) FILTER (n > 0), 0), 0.001), 0.001), 0.5) AS spread FROM {0})"""
_HOST_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS r FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
outcomes AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS y, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts
  FROM split LEFT JOIN outcomes ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) GROUP BY host),
hosts AS (
  SELECT host, n, y, parts[-1] AS suffix, array_to_string(parts[greatest(1, len(parts) - 1):], '.') AS domain FROM counts),
suffix_sums AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM hosts GROUP BY suffix),
suffixes AS (
  SELECT s.*, t.n - s.n + 2.0::DOUBLE AS worth, (t.y - s.y + 1) / (t.n - s.n + 2) AS prior
  FROM suffix_sums s, (SELECT sum(n) AS n, sum(y) AS y FROM hosts) t),
suffix_fit AS ({_FITTED.format("suffixes")}),
domain_sums AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM hosts GROUP BY domain, suffix),
domains AS (
  SELECT d.*, p.strength + p.n - d.n AS worth, (p.strength * p.prior + p.y - d.y) / (p.strength + p.n - d.n) AS prior
  FROM domain_sums d JOIN suffix_fit p ON d.suffix = p.suffix),
domain_fit AS ({_FITTED.format("domains")}),
placed AS (
  SELECT h.host, h.n, h.y, p.strength + p.n - h.n AS worth, (p.strength * p.prior + p.y - h.y) / (p.strength + p.n - h.n) AS prior
  FROM hosts h JOIN domain_fit p ON h.domain = p.domain AND h.suffix = p.suffix),
host_post AS (
  SELECT host, (strength * prior + y) / (strength + n) AS mean, sqrt(mean * (1 - mean) / (strength + n + 1)) AS deviation
  FROM ({_FITTED.format("placed")})),
rules AS (
  SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}) AS t(verdict, rule_host, rule_path)),
fits AS (
  SELECT s.page_id, r.rule_host || r.rule_path AS rule, r.verdict FROM split s
  JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
  QUALIFY row_number() OVER (PARTITION BY s.page_id ORDER BY len(r.rule_host || r.rule_path) DESC) = 1)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.verdict, CASE WHEN p.mean - 1.645 * p.deviation > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       p.mean AS bad_rate, p.mean - 1.645 * p.deviation AS bad_bound
FROM split s JOIN host_post p ON s.host = p.host LEFT JOIN fits f ON s.page_id = f.page_id"""


@query("op9_host_reputation", _HOST_SQL)
def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


_LINES_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, pos, list_transform(regexp_extract_all(lines[pos], '[^\x20\x09-\x0D]+'),
                                     lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM docs, unnest(range(1, len(lines) + 1)) AS u(pos)),
long_lines AS (SELECT *, (len(tokens), tokens[1:3]) AS leaf FROM lines WHERE len(tokens) >= 5),
kinds AS (SELECT leaf, tokens, min(doc_id) AS first, max(doc_id) AS last FROM long_lines GROUP BY leaf, tokens),
each AS (SELECT k.*, place, tokens[place] AS token FROM kinds k, unnest(range(1, len(tokens) + 1)) AS u(place)),
constant AS (
  SELECT leaf, place, token FROM each WHERE place > 3 AND token <> '<*>' GROUP BY leaf, place, token HAVING min(first) < max(last)),
formed AS (
  SELECT e.leaf, e.tokens, e.first, e.last,
         coalesce(list((e.place, e.token) ORDER BY e.place) FILTER (c.token IS NOT NULL OR (e.place <= 3 AND e.token <> '<*>')), []) AS form
  FROM each e LEFT JOIN constant c ON e.leaf = c.leaf AND e.place = c.place AND e.token = c.token
  GROUP BY e.leaf, e.tokens, e.first, e.last),
recurring AS (
  SELECT leaf, form, min(first) AS first FROM formed WHERE len(form) >= 0.75 * len(tokens)
  GROUP BY leaf, form HAVING min(first) < max(last)),
drops AS (
  SELECT l.doc_id, list(l.pos) AS gone FROM long_lines l
  JOIN formed f ON l.tokens = f.tokens JOIN recurring r ON f.leaf = r.leaf AND f.form = r.form
  WHERE len(f.form) >= 0.75 * len(f.tokens) AND l.doc_id > r.first GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)), '') END AS text
FROM docs d LEFT JOIN drops x ON d.doc_id = x.doc_id"""


@query("op5_line_templates", _LINES_SQL)
def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_wrapper_text")
def wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


_FIM_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


@query("op13_piece_table_fim", _FIM_SQL)
def piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"], with_output=False)


@query("op12_positive_unlabelled")
def positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_NEGATIVES_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT row, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY s.row, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.row = p.row AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY s.row, place ORDER BY score DESC, vec_id) <= 10"""


@query("op11_threshold_join_negatives", _NEGATIVES_SQL)
def threshold_join_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)
