"""The queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

from cairn.llm import alignment, html, language, linededup, minhash, mixing, neighbours, packing, passages, ranking, suffixes, tokens, vectors


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_html_extraction": html.op3_html_extraction,
        "op4_embedding_near_dedup": vectors.op4_embedding_near_dedup,
        "op5_substring_dedup": passages.op5_substring_dedup,
        "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
        "op9_language_id": language.op9_language_id,
        "op10_line_dedup": linededup.op10_line_dedup,
        "op11_suffix_array_dedup": suffixes.op11_suffix_array_dedup,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_ranked_search": ranking.op13_ranked_search,
    }


def oracle_sql():
    return {"op1_mixing": mixing.OP1_SQL, "op10_line_dedup": linededup.OP10_SQL, "op13_ranked_search": ranking.OP13_SQL}
