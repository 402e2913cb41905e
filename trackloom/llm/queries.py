"""Queries that apply the corpus operators to whole tables, and SQL for those that SQL can express.

The digests and held-out marks that the queries return are derived here; the
operators have their own outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ans, balltree, bpe, decontam, langid, licenses, neardup, pii, prefix_counts, topk, toxicity, warc
from .scratch import Scratch, text_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs.where(_remainder(4) != 2), key=F.col("doc_id"))
    out = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), RANKS, as_bytes=True, keep=["doc_id"], decoded_col="decoded")
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").root
    ans.write_tokens(_documents(spark, sf_dir), path, TOKENIZER, end_id=0)
    return ans.read_tokens(spark, path, with_ids=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(5) != 0)
    out = toxicity.classify(docs.select("doc_id", "text"), toxicity.train(docs, labels), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = pii.detect(docs, pii.train(docs), keep=["doc_id"])

    def written(spans: str) -> str:
        return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"

    counts = [F.expr(f"cast(size(filter(pii, x -> x.exact and x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return out.select("doc_id", *counts, F.expr(f"sha2({written('filter(pii, x -> x.exact)')}, 256)").alias("base_sha256"), F.expr(written("pii")).alias("spans"))


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.expr("cast(octet_length(coalesce(text, '')) as long)").alias("n_bytes"))
    out = prefix_counts.over_budget(docs, TOKENIZER, 1024, keep=["doc_id", "n_bytes"])
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_1024")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), share=85, size=5)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "warc")
    warc.write(text_batches(spark).read.parquet(f"{sf_dir}/pages.parquet"), work.path("archives"), work)
    back = warc.read(spark, work.path("archives"), with_payload=False)
    return back.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "centroids"), k=16, rounds=3, width=64, scale=64.0, seed="1")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir), TOKENIZER, PIECES, Scratch(spark, "alignment"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_byte_bpe, op3_token_files, op4_license_scan, op5_toxicity, op6_pii, op7_prefix_counts, op8_exact_top_k, op9_near_duplicates, op10_decontamination, op11_warc, op12_centroids, op13_token_alignment)
    return {f.__name__: f for f in own}


_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""
_RUNS = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, vec_id, score FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sets AS (SELECT doc_id, {_RUNS} AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS hits
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
),
links AS (SELECT u, v FROM shared WHERE 100 * hits >= 85 * (nu + nv - hits)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM sets
  UNION
  SELECT ways.v, reach.r FROM reach JOIN ways ON reach.d = ways.u
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, min(reach.r) AS component_id, sets.doc_id = min(reach.r) AS kept
FROM sets JOIN reach ON reach.d = sets.doc_id GROUP BY sets.doc_id, sets.s
"""

_CONTAINED = f"""
WITH d AS (SELECT doc_id, {_RUNS} AS s FROM (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents)),
b AS (SELECT item_id, {_RUNS} AS s FROM (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark)),
dx AS (SELECT doc_id, unnest(s) AS x FROM d),
bx AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM b),
c AS (SELECT doc_id, item_id, n, count(*) AS hits FROM dx JOIN bx USING (x) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, hits AS n_shared, hits / n AS containment FROM c WHERE 10 * hits >= 8 * n
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
n AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM n)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""


def _centroids(k: int, rounds: int, width: int) -> str:
    """SQL of op12: an assignment and an update a round."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS cluster, e FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} AS MATERIALIZED (
  SELECT v.r, arg_min(c.cluster, (list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e), c.cluster)) AS cluster,
    CAST(min(list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e)) AS BIGINT) AS distance
  FROM v CROSS JOIN c{t} c GROUP BY v.r
)"""
        )
        if t < rounds:
            parts.append(
                f"""s{t} AS (
  SELECT cluster, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(v.e) AS x, unnest(range({width})) AS i FROM a{t} a JOIN v USING (r)) GROUP BY ALL
), c{t + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{t} c
  LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n + n) % n)) // n AS DOUBLE) ORDER BY i) AS e FROM s{t} GROUP BY cluster) m USING (cluster)
)"""
            )
    return f"""
WITH {", ".join(parts)}
SELECT v.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c USING (cluster)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": _TOP_K, "op9_near_duplicates": _NEAR, "op10_decontamination": _CONTAINED, "op11_warc": _WARC, "op12_centroids": _centroids(16, 3, 64)}
