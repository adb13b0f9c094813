"""The operators of this package bound to the given tables, with production parameters and no limits."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from helixframe.llm import (
    articles, centroids, credentials, decontamination, edits, mixing, negatives, packing, simhash, surrogates, tokens, toxicity, urls,
)
from helixframe.llm.common import prepare
from helixframe.plans.registry import Suite, Tables

suite = Suite()
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(t: Tables, name: str):
    prepare(t.spark)
    return getattr(t, name)


@suite.query("op1_packing")
def _(t):
    return packing.pack(table(t, "documents"), TOKENIZER, RANKS).select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_tokens",
    )


@suite.query("op3_token_counts")
def _(t):
    return tokens.token_counts(table(t, "documents"), TOKENIZER)


@suite.query("op2_simhash")
def _(t):
    return simhash.near_duplicates(table(t, "documents"))


@suite.query("op4_decontamination")
def _(t):
    return decontamination.matches(table(t, "documents"), table(t, "benchmark")).select(
        "doc_id", "item_id", "matched", "windows", "share", "changed")


@suite.query("op5_toxicity")
def _(t):
    return toxicity.toxicity(table(t, "documents"), table(t, "labels"))


@suite.query("op8_secrets")
def _(t):
    return credentials.digest_columns(credentials.scan(table(t, "documents")))


#: The rules of the contract.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
SURROGATE_KEY = "corpus"


@suite.query("op6_urls")
def _(t):
    return urls.judged(table(t, "pages"), URL_RULES)


@suite.query("op7_edits")
def _(t):
    return edits.with_edits(table(t, "documents"))


@suite.query("op9_articles")
def _(t):
    return articles.extracted(table(t, "pages"))


@suite.query("op10_surrogates")
def _(t):
    return surrogates.pseudonymised(table(t, "documents"), SURROGATE_KEY)


@suite.query("op11_mixing")
def _(t):
    return mixing.scores(table(t, "documents"))


@suite.query("op12_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5""")
def _(t):
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(t, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(rows, vec_id % 100 == 0)


def _clusters_sql(clusters: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, width: int = 64) -> str:
    """Each round is two table expressions: the nearest centroid of every vector, and the next centroids."""

    def nearest(k: int) -> str:
        return f"""
d{k} AS (SELECT vec_id, v, cluster, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS distance FROM kept, c{k}),
a{k} AS MATERIALIZED (SELECT vec_id, v, cluster, distance FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""

    def centres(k: int) -> str:
        return f"""
x{k} AS (SELECT cluster, place, CAST(sum(v[place]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(1, {width + 1}) r(place) GROUP BY cluster, place),
m{k} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY place) AS c FROM x{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))"""

    steps = ",".join(part for k in range(rounds) for part in (nearest(k), centres(k)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale} * x)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h LIMIT {clusters})),{steps},{nearest(rounds)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@suite.query("op13_centroids", _clusters_sql())
def _(t):
    return centroids.clustered(table(t, "embeddings")).drop("evaluated")


@suite.query("pipeline")
def _(t):
    return corpus_pipeline.run(t.spark, t.folder)
