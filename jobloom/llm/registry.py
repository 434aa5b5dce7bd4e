"""The queries of this package and their SQL."""

from __future__ import annotations

from . import ann, bpe, fim, hard_negatives, hpylm, langid, line_dedup, minhash, mixing, pii, substring_dedup, token_files, vector_dedup


def queries() -> dict:
    return {
        "op1_nearest": ann.op1_nearest,
        "op2_mix_to_weights": mixing.op2_mix_to_weights,
        "op3_near_vectors": vector_dedup.op3_near_vectors,
        "op4_pii": pii.op4_pii,
        "op5_token_files": token_files.op5_token_files,
        "op6_near_duplicates": minhash.op6_near_duplicates,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_lm_scores": hpylm.op8_lm_scores,
        "op9_language_id": langid.op9_language_id,
        "op10_bpe": bpe.op10_bpe,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_substring_dedup": substring_dedup.op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_to_weights": mixing.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_fill_in_middle": fim.SQL, "op13_substring_dedup": substring_dedup.SQL}
