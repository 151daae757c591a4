"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, contamination, conversations, forest, language, packing, pii, pitman_yor, sharding, simhash, toxicity, voronoi


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_voronoi_top_k": voronoi.query,
        "op3_simhash_groups": simhash.query,
        "op4_bpe_round_trip": bpe.query,
        "op5_pitman_yor_scores": pitman_yor.query,
        "op6_hash_tree_shards": sharding.query,
        "op7_language_id": language.query,
        "op8_best_fit_packing": packing.query,
        "op9_personal_data": pii.query,
        "op10_forest_neighbours": forest.query,
        "op11_fm_decontamination": contamination.query,
        "op12_conversation_repair": conversations.query,
        "op13_collocations": collocations.query,
    }


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_voronoi_top_k": OP2_SQL, "op11_fm_decontamination": contamination.SQL, "op13_collocations": collocations.SQL}
