"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import alignment, html_text, katz, mixing, pii, quality, sharding, simhash, spm, suffix_dedup, topk, toxicity, whitening

_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s
), o AS (
  SELECT *, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS w_before,
         row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS total_w
  FROM w
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, CAST(total - cap_before AS DOUBLE) / (total_w - w_before) AS share FROM o
), l AS (
  SELECT coalesce(arg_min(share, place) FILTER (WHERE NOT share * weight > cap), 0) AS level FROM f
), t AS (
  SELECT source, source_size,
         least(CASE WHEN share * weight > cap THEN CAST(cap AS DOUBLE) ELSE level * weight END, CAST(cap AS DOUBLE)) AS target
  FROM f, l
), b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t
), r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM r
"""

OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(CASE WHEN a.dim = 0 THEN 0 ELSE list_dot_product(a.q, b.q) END AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.uid <> b.uid AND a.dim = b.dim
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {
    "op1_weak_supervision": pii.op1_weak_supervision,
    "op2_feistel_shards": sharding.op2_feistel_shards,
    "op3_ball_tree_topk": topk.op3_ball_tree_topk,
    "op4_piece_codec": spm.op4_piece_codec,
    "op5_tag_path_ratios": html_text.op5_tag_path_ratios,
    "op6_tokeniser_fertility": quality.op6_tokeniser_fertility,
    "op7_simhash_components": simhash.op7_simhash_components,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_ordinal_severity": toxicity.op9_ordinal_severity,
    "op10_prefix_doubling": suffix_dedup.op10_prefix_doubling,
    "op11_aligned_vocabularies": alignment.op11_aligned_vocabularies,
    "op12_whitened_embeddings": whitening.op12_whitened_embeddings,
    "op13_katz_backoff": katz.op13_katz_backoff,
}

ORACLES = {"op3_ball_tree_topk": OP3_SQL, "op8_mix_sources": OP8_SQL}
