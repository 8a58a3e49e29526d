"""Queries of the training-data operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from crossgauge.llm import collocations, decontaminate, histogram_shard, language_id, license_scan, line_quality, ngram_jaccard, online_packing, packing, quality_classifier, suffix_dedup, token_alignment, token_files

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_language_id": language_id.op6_language_id,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_histogram_shard": histogram_shard.op8_histogram_shard,
    "op9_line_quality": line_quality.op9_line_quality,
    "op10_token_files": token_files.op10_token_files,
    "op11_online_packing": online_packing.op11_online_packing,
    "op12_collocations": collocations.op12_collocations,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL = {
    "op3_license_scan": license_scan.ORACLE,
    "op9_line_quality": line_quality.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
