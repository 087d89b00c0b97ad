"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontamination, language, near_dedup, packing, quality_classifier, quality_rules, secrets, substring_dedup, token_alignment, toxicity, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_secret_scans": secrets.op2_secret_scans,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_packing": packing.op9_packing,
        "op10_language": language.op10_language,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_url_filter": url_filter.op12_url_filter,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat_format.OP3_SQL, "op12_url_filter": url_filter.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
