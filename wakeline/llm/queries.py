"""The queries of this package, by name, and the SQL that checks those SQL can express."""

from __future__ import annotations

import corpus_pipeline

from wakeline.llm import chat, collocations, decontaminate, language_id, lattice_lm, near_dedup, packing, pii
from wakeline.llm import quality_knn, sharding, token_alignment, topk, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.query,
    "op1_candidate_boosting": pii.op1_candidate_boosting,
    "op2_lattice_likelihood": lattice_lm.op2_lattice_likelihood,
    "op3_markov_ratio": url_filter.op3_markov_ratio,
    "op4_order_minhash": near_dedup.op4_order_minhash,
    "op5_external_shuffle": sharding.op5_external_shuffle,
    "op6_neighbour_voting": quality_knn.op6_neighbour_voting,
    "op7_language_ppm": language_id.op7_language_ppm,
    "op8_threshold_top_k": topk.op8_threshold_top_k,
    "op9_positional_index": decontaminate.op9_positional_index,
    "op10_bin_completion": packing.op10_bin_completion,
    "op11_level_wise_collocations": collocations.op11_level_wise_collocations,
    "op12_offset_masks": chat.op12_offset_masks,
    "op13_packed_bitsets": token_alignment.op13_packed_bitsets,
}

SQL: dict[str, str] = {
    "op8_threshold_top_k": topk.SQL,
    "op9_positional_index": decontaminate.SQL,
    "op11_level_wise_collocations": collocations.SQL,
    "op12_offset_masks": chat.SQL,
}
