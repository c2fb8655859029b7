"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, chunk_dedup, class_lm, divergence, embed_dedup, html_extract, near_dup, packing, prefix_trie, source_mix, topk, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_class_lm": class_lm.op1_class_lm,
        "op2_near_dup": near_dup.op2_near_dup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_embed_dedup": embed_dedup.op6_embed_dedup,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_chunk_dedup": chunk_dedup.op8_chunk_dedup,
        "op9_source_mix": source_mix.op9_source_mix,
        "op10_exact_topk": topk.op10_exact_topk,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_best_fit_pack": packing.op13_best_fit_pack,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mix": source_mix.OP9_SQL, "op10_exact_topk": topk.OP10_SQL, "op11_source_divergence": divergence.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
