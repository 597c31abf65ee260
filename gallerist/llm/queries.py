"""The thin queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, line_dedup, mixing, near_dedup, packing, ppm_scoring, quality_rules, resampling, suffix_dedup, tiff, token_counts, toxicity
from ._common import documents, id_fold


def tokenizer(name: str) -> tuple[str, str]:
    """The path of a public vocabulary and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def pack(docs: DataFrame) -> DataFrame:
    """docs packed by byte_bpe_50k.json, whose vocabulary the ranks are, with its added tokens."""
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs, path, pattern, added=packing.added_tokens(tokenizer("byte_bpe_50k.json")[0]))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = line_dedup.strip_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    stats = [F.col(name)[n].alias(n) for n in ("n_lines", "n_removed", "n_runs", "longest_run")]
    return out.select("doc_id", *stats, F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest_pages(tiff.media_documents(documents(spark, sf_dir)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(documents(spark, sf_dir), labels, id_fold("id", 4) == 2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.score_documents(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scoring.score(documents(spark, sf_dir), id_fold("id", 7) == 2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(documents(spark, sf_dir), path, pattern)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), path, pattern, with_ids=False).drop("ids")


def op9_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, seed=1)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_tiff_media, op3_suffix_dedup, op4_toxicity, op5_quality_rules, op6_ppm_scoring, op7_token_counts, op8_byte_bpe, op9_certified_packing, op10_setsketch_near_dedup, op11_centroid_clustering, op12_importance_resampling, op13_source_mixing)}


_RULE_MEASURES = """
  n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars / greatest(n_words, 1)::DOUBLE BETWEEN 2 AND 14
    AND n_symbols / greatest(n_words, 1)::DOUBLE <= 0.10
    AND n_stop / greatest(n_words, 1)::DOUBLE >= 0.01
    AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.50
    AND n_alpha / greatest(n_words, 1)::DOUBLE >= 0.60
    AND n_bullet / greatest(n_lines, 1)::DOUBLE <= 0.90
    AND n_ellipsis / greatest(n_lines, 1)::DOUBLE <= 0.50 AS kept
"""


def quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM d),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS win,
    unnest(range(1, len(w) - 1)) AS i FROM s),
c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \\t-\\r]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*\u2022]'))) AS n_bullet,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026)[ \\t\\r]*$'))) AS n_ellipsis
  FROM s LEFT JOIN r USING (doc_id))
SELECT doc_id, {_RULE_MEASURES} FROM m
"""


LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
w AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
c AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS copy
  FROM w WHERE line3 IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM c WHERE copy > 1),
runs AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone)
  GROUP BY doc_id, island),
r AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run, sum(n) AS n_removed FROM runs GROUP BY doc_id),
k AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT doc_id, n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0) AS n_runs,
  coalesce(longest_run, 0)::BIGINT AS longest_run, md5(coalesce(kept, '')) AS kept_md5
FROM n LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM l JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
c AS (
  SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
m AS (SELECT id, min(root) AS component_id FROM c GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN m ON m.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def clustering_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """Lloyd's rounds written out, one after the other."""
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, v, q[1] AS distance, q[2] AS cluster FROM (
    SELECT vec_id, any_value(v) AS v, min([list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, j]) AS q
    FROM kept, c{r} GROUP BY vec_id)),""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT cluster, list({floor} ORDER BY pos) AS c
  FROM (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({size})) AS pos FROM a{r}) GROUP BY ALL) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON cluster = j),""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v)) - 1 AS j, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})),{"".join(steps)}
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, a{rounds}.cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{rounds}) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN i USING (cluster) JOIN c{rounds} ON j = a{rounds}.cluster
"""


def resampling_sql(width: int = 3, buckets: int = 10_000, least_words: int = 20, percent: int = 5) -> str:
    """crc32 byte by byte over a table made from its polynomial, once for each distinct feature."""
    return f"""
WITH t AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
  FROM range(256) x(i)),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS MATERIALIZED (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts),
f AS MATERIALIZED (
  SELECT kind, id, unnest(list_concat({", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in range(1, width + 1))})) AS f FROM w),
b AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(string_split(rtrim(regexp_replace(hex(encode(f)), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {buckets} AS bucket
  FROM (SELECT DISTINCT f FROM f), t),
p AS MATERIALIZED (SELECT kind, id, bucket FROM f JOIN b USING (f)),
n AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM p GROUP BY bucket),
a AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM n),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + {buckets})::DOUBLE / ((s + 1)::DOUBLE * (all_t + {buckets})::DOUBLE)))::BIGINT AS gain FROM n, a),
d AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM p JOIN g USING (bucket) WHERE kind = 0 GROUP BY id),
e AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || sha256('42:' || id)[:8])::BIGINT AS h FROM w LEFT JOIN d ON d.doc_id = id WHERE kind = 0),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_words >= {least_words}
  QUALIFY rank <= (SELECT {percent} * count(*) // 100 FROM c WHERE n_words >= {least_words}))
SELECT doc_id, n_features, weight, score, rank FROM c LEFT JOIN r USING (doc_id)
"""


def mixing_sql(block: int = mixing.BLOCK, per_shard: int = mixing.PER_SHARD, limit: int = mixing.LIMIT, seed: int = 42) -> str:
    """Quotients ranked one by one, for sources and for each source's shards, and blocks by their hashes."""
    return f"""
WITH RECURSIVE z AS MATERIALIZED (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
o AS MATERIALIZED (
  SELECT source, source_size, place, place % 3 + 1 AS weight, sum(source_size) OVER () AS words
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM z GROUP BY source)),
level AS (
  SELECT 0 AS round, 0::BIGINT AS n_full, max(words)::DOUBLE AS rest, sum(weight)::DOUBLE AS shares FROM o
  UNION ALL
  SELECT round + 1, n, rest2, shares2 FROM (
    SELECT l.round, l.n_full, count(*) FILTER (full_) AS n, (max(words) - coalesce(sum({limit} * source_size) FILTER (full_), 0))::DOUBLE AS rest2, coalesce(sum(weight) FILTER (NOT full_), 1)::DOUBLE AS shares2
    FROM (SELECT l.*, o.*, l.rest * o.weight / l.shares > {limit} * o.source_size AS full_ FROM level l, o) l GROUP BY l.round, l.n_full)
  WHERE n > n_full),
u AS MATERIALIZED (
  SELECT o.*, least(rest * weight / shares, {limit}.0::DOUBLE * source_size) AS target FROM o, (SELECT rest, shares FROM level ORDER BY round DESC LIMIT 1)),
q AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, place, s) AS nth, words
  FROM (SELECT *, unnest(range({limit} * ceil(source_size / {block}::DOUBLE)::BIGINT)) AS s FROM u)),
seats AS (SELECT place, count(*) AS seats FROM q WHERE nth <= (2 * words + {block}) // {2 * block} GROUP BY place),
v AS MATERIALIZED (SELECT u.*, ceil(source_size / {block}::DOUBLE)::BIGINT AS blocks, coalesce(seats, 0) AS seats FROM u LEFT JOIN seats USING (place)),
shard AS MATERIALIZED (
  SELECT place, seats, shard, least({per_shard}, blocks - shard * {per_shard}) AS n
  FROM (SELECT *, unnest(range((blocks + {per_shard - 1}) // {per_shard})) AS shard FROM v)),
quota AS (
  SELECT place, shard, any_value(n) AS n, count(*) FILTER (nth <= seats) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n::DOUBLE / (2 * s + 1) DESC, shard, s) AS nth FROM (SELECT *, unnest(range({limit} * n)) AS s FROM shard))
  GROUP BY place, shard),
times AS MATERIALIZED (
  SELECT place, b, quota // n + (row_number() OVER (PARTITION BY place, shard ORDER BY md5('{seed}:' || place || ':' || b)) <= quota % n)::INT AS times
  FROM (SELECT *, unnest(range(shard * {per_shard}, shard * {per_shard} + n)) AS b FROM quota)),
y AS MATERIALIZED (
  SELECT z.*, row_number() OVER () AS row, place, source_size, target, sum(size) OVER (PARTITION BY z.source ORDER BY doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM z JOIN v ON z.source IS NOT DISTINCT FROM v.source),
k AS (
  SELECT row, sum(times * (least(start + size, (b + 1) * {block}) - greatest(start, b * {block}))) AS taken
  FROM (SELECT *, unnest(range((start // {block})::BIGINT, ((start + size - 1) // {block} + 1)::BIGINT)) AS b FROM y WHERE size > 0) JOIN times USING (place, b) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM y LEFT JOIN k USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": clustering_sql(), "op12_importance_resampling": resampling_sql(), "op13_source_mixing": mixing_sql(), "op1_line_dedup": LINES_SQL, "op10_setsketch_near_dedup": NEAR_SQL, "op5_quality_rules": quality_sql()}
