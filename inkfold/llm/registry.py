"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chosen_path, langid, licenses, maxent_lm, packing, sentencepieces, simhash, substrings, token_store, topk

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_sentencepiece": sentencepieces.op2_sentencepiece,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash": simhash.op4_simhash,
    "near_fingerprints": simhash.near_fingerprints,
    "op5_top_k": topk.op5_top_k,
    "op6_jaccard_join": chosen_path.op6_jaccard_join,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_lm_score": maxent_lm.op9_lm_score,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLE_SQL = {
    "op5_top_k": topk.OP5_SQL,
    "op8_license_scan": licenses.OP8_SQL,
}
