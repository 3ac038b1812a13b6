"""Registered queries of the subpackage and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from transit_spark.llm import (
    decontamination, filter_audit, fm_index, language, negatives, neighbours, pieces, quality, secrets, sharding, simhash,
    suffix_dedup, token_files,
)
from transit_spark.plans.registry import Registry

reg = Registry()


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bn)),
ks AS (SELECT DISTINCT k FROM bn),
occ AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, occ.k AS k, i FROM occ JOIN win USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@reg.query("op4_decontamination", DECONTAMINATION_SQL)
def op4_decontamination(spark, sf_dir):
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@reg.query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@reg.query("op5_token_files")
def op5_token_files(spark, sf_dir):
    return token_files.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


SHARDING_SQL = r"""
WITH steps AS (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c
               FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps),
d AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, md5('42:' || doc_id) AS key,
             xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
                 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
                 lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
      FROM documents, tab),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 1)::DOUBLE
                / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, key, doc_id, text_crc32, size) - 1 AS place,
             count(*) OVER () AS n FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(place * 8 // n AS INTEGER) AS shard, CAST(place - ((place * 8 // n) * n + 7) // 8 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""


@reg.query("op6_sharding", SHARDING_SQL)
def op6_sharding(spark, sf_dir):
    return sharding.digest(sharding.shards(table(spark, sf_dir, "documents")))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
p AS (SELECT doc_id, list(DISTINCT p) AS gone
      FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE least < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, list(word ORDER BY p) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
      ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM p) USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@reg.query("op8_substring_dedup", SUBSTRING_SQL)
def op8_substring_dedup(spark, sf_dir):
    return fm_index.digest(fm_index.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


@reg.query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


@reg.query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@reg.query("op2_language_id")
def op2_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@reg.query("op9_nearest_neighbours")
def op9_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.neighbours(vectors, vectors.where("vec_id % 50 = 0"))


@reg.query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    return pieces.digest(pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


FILTER_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
              100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(first_id < d.doc_id, false)] AS fails
      FROM d JOIN firsts USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
k AS (SELECT unnest(range(1, 6)) AS v),
o AS (SELECT [a.v, b.v, c.v, d.v, e.v] AS places FROM k a, k b, k c, k d, k e
      WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT places, v AS step, array_to_string(list_transform(places, lambda p: chr(CAST(64 + p AS INTEGER))), '') AS filter_order FROM o, k),
r AS (SELECT part, filter_order, step, n, good, toxic, fails[places[step]] AS fails_it,
             list_bool_or(list_transform(places[:step - 1], lambda p: fails[p])) IS TRUE AS gone,
             len(list_filter(fails, lambda x: x)) AS failed FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN fails_it AND failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN fails_it THEN n * 120 // failed ELSE 0 END) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""


@reg.query("op12_filter_interaction_audit", FILTER_AUDIT_SQL)
def op12_filter_interaction_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SECRETS_SQL = r"""
WITH names AS (SELECT '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|'
                      || '[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?' AS lead),
forms AS (SELECT 0 AS place, 'assign' AS kind, lead || '[A-Za-z0-9+/_.=-]+' AS pattern FROM names
          UNION ALL SELECT 1, 'access', 'AKIA[A-Z0-9]+' UNION ALL SELECT 2, 'hex', '[0-9a-f]+'
          UNION ALL SELECT 3, 'token', '[A-Za-z0-9+/_-]{16,}={0,2}'),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS owner, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, place, kind, regexp_extract_all(text, pattern) AS found,
             list_transform(string_split_regex(text, pattern), lambda g: length(g)) AS gaps FROM d, forms),
e AS (SELECT r, place, kind, unnest(found) AS value, unnest(range(1, len(found) + 1)) AS i, gaps,
             list_transform(found, lambda f: length(f)) AS sizes FROM m WHERE len(found) > 0),
big AS (SELECT * FROM e WHERE place <> 2 OR length(value) >= 24),
s AS (SELECT r, place, kind, value, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT) AS a, length(value) AS n
      FROM big),
v AS (SELECT r, place, kind, a, a + n AS b,
             CASE place WHEN 0 THEN regexp_extract(value, lead || '([A-Za-z0-9+/_.=-]+)$', 1) ELSE value END AS value FROM s, names),
base AS (SELECT * FROM v WHERE place = 0 AND length(value) >= 6 OR place = 1 AND length(value) >= 20 OR place = 2),
token AS (SELECT * FROM v WHERE place = 3 AND len(regexp_extract_all(value, '[A-Za-z][0-9]')) >= 3
                            AND len(list_distinct(string_split(value, ''))) >= 8
          AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = v.r AND base.a < v.b AND v.a < base.b)),
seen AS (SELECT * FROM base UNION ALL SELECT * FROM token),
owned AS (SELECT value, count(DISTINCT owner) AS owners, max(place) < 4 AND min(place) < 3 AS is_base FROM seen JOIN d USING (r) GROUP BY value),
j AS (SELECT r, place, a, b, owners, CASE WHEN place < 3 THEN kind WHEN is_base THEN 'reused' WHEN owners <= 1 THEN 'owned' END AS kind
      FROM seen JOIN owned USING (value)),
g AS (SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place < 3) AS base,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (kind IS NOT NULL) AS spans,
             count(*) FILTER (place < 3 AND owners <= 1) AS n_live, count(*) FILTER (place < 3 AND owners > 1) AS n_copied
      FROM j GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN g USING (r)
"""


@reg.query("op13_secret_scan", SECRETS_SQL)
def op13_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


HARD_NEGATIVES_SQL = r"""
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, q) = 1),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
             CAST(list_inner_product(a.q, o.q) AS BIGINT) AS score
      FROM one a JOIN one o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""


@reg.query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@reg.query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
