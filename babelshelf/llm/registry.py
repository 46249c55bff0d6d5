"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from babelshelf.llm import binary, counts, exact, html, lexical, media, mixing, negatives, neighbours, packing, quality, shards, simhash

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_bayes, simhash.op2_simhash, shards.op3_histogram_sort, exact.op4_digest_index, packing.op5_bounded_windows,
        binary.op6_bit_packed, counts.op7_two_tier_counts, mixing.op8_cube_mix, media.op9_log_mel, html.op10_layout_text,
        lexical.op11_tput_search, negatives.op12_voronoi_negatives, neighbours.op13_rotated_codes,
    )
}
ORACLES = {"op4_digest_index": exact.OP4_SQL, "op11_tput_search": lexical.OP11_SQL, "op12_voronoi_negatives": negatives.OP12_SQL, "op13_rotated_codes": neighbours.OP13_SQL}
