"""Queries of this package and their SQL, by name."""

from wakeline.llm import (
    collocations,
    decontamination,
    language_id,
    lexical_search,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    page_text,
    pii,
    quality_model,
    quality_rules,
    substring_dedup,
)

QUERIES = {
    "op1_page_text": page_text.op1_page_text,
    "op2_surrogates": pii.op2_surrogates,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_model": quality_model.op5_quality_model,
    "op6_fair_mix": mixing.op6_fair_mix,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op4_decontamination": decontamination.SQL,
    "op6_fair_mix": mixing.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op12_lexical_search": lexical_search.SQL,
    "op13_collocations": collocations.SQL,
}
