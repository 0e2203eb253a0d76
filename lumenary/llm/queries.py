"""The registry of this package: query name -> (spark, sf_dir) -> DataFrame, and the SQL where it can say the same."""

from __future__ import annotations

from . import conflict_pack, feistel_shards, grade_model, line_crf, media_shards, ngram_trie, page_wrappers, simhash_dedup, source_mix, token_pack


def queries() -> dict:
    return {
        "op1_ngram_trie": ngram_trie.op1_ngram_trie,
        "op2_token_pack": token_pack.op2_token_pack,
        "op3_line_crf": line_crf.op3_line_crf,
        "op4_feistel_shards": feistel_shards.op4_feistel_shards,
        "op5_grade_model": grade_model.op5_grade_model,
        "op6_page_wrappers": page_wrappers.op6_page_wrappers,
        "op7_conflict_pack": conflict_pack.op7_conflict_pack,
        "op8_source_mix": source_mix.op8_source_mix,
        "op9_media_shards": media_shards.op9_media_shards,
        "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mix": source_mix.oracle()}
