"""The queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from knotlog.llm import ann, bpe_codec, decontaminate, language_id, line_dedup, near_dedup, quality, secret_scan, source_mix, spelling, substring_dedup, token_alignment, token_counts

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_source_mix": source_mix.op2_source_mix,
    "op3_quality": quality.op3_quality,
    "op4_language_id": language_id.op4_language_id,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_bpe_codec": bpe_codec.op7_bpe_codec,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_ann": ann.op9_ann,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_spelling": spelling.op11_spelling,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op11_spelling": spelling.SQL,
    "op12_decontaminate": decontaminate.SQL,
}
