"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from . import centroids, exact_dedup, jaccard_join, learned_partitions, lexical_search, line_templates, mixing, packing, passages, suffix_dedup, toxicity, vector_search, warc


def registry() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_passages": passages.op2_passages,
        "op3_packing": packing.op3_packing,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_warc": warc.op7_warc,
        "op8_mixing": mixing.op8_mixing,
        "op9_line_templates": line_templates.op9_line_templates,
        "op10_vector_search": vector_search.op10_vector_search,
        "op11_learned_partitions": learned_partitions.op11_learned_partitions,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle() -> dict[str, str]:
    return {
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op7_warc": warc.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "op10_vector_search": vector_search.ORACLE,
        "op12_lexical_search": lexical_search.ORACLE,
        "op13_centroids": centroids.ORACLE,
    }
