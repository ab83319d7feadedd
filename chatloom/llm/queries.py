"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from chatloom.llm import chat_format, decontaminate, embedding_dedup, language_id, license_scan, mixing, ngram_join, packing, periodic_runs, suffix_dedup, token_counts, token_files, turn_repair

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_token_files": token_files.op8_token_files,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_mixing": mixing.op12_mixing,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}
ORACLE_SQL = {"op2_chat_format": chat_format.ORACLE, "op3_license_scan": license_scan.oracle()}
