"""Queries and SQL of the corpus operators, for the entry module."""

from __future__ import annotations

from . import alignment, bpe, decontamination, html_text, language_id, language_model, quality_classifier, quality_rules, simhash, spelling, substring_dedup, toxicity, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_bpe": lambda spark, d: bpe.op2_bpe(spark, d),
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_simhash": simhash.op8_simhash,
    "op9_warc": warc.op9_warc,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_lm_scoring": language_model.op12_lm_scoring,
    "op13_alignment": alignment.op13_alignment,
}

SQL: dict[str, str] = {
    "op5_decontamination": decontamination.SQL,
    "op9_warc": warc.SQL,
    "op11_spelling": spelling.SQL,
}
