"""The queries of this subpackage and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from . import op01_decontamination, op02_pii, op03_licenses, op04_simhash, op05_quality_mil, op06_sharding, op07_chat, op08_mixing, op09_warc, op10_quality_rules, op11_whitening, op12_ranked_search, op13_html_text

QUERIES = {
    "op1_decontamination": op01_decontamination.op1_decontamination,
    "op2_pii": op02_pii.op2_pii,
    "op3_licenses": op03_licenses.op3_licenses,
    "op4_simhash": op04_simhash.op4_simhash,
    "op5_quality_mil": op05_quality_mil.op5_quality_mil,
    "op6_sharding": op06_sharding.op6_sharding,
    "op7_chat": op07_chat.op7_chat,
    "op8_mixing": op08_mixing.op8_mixing,
    "op9_warc": op09_warc.op9_warc,
    "op10_quality_rules": op10_quality_rules.op10_quality_rules,
    "op11_whitening": op11_whitening.op11_whitening,
    "op12_ranked_search": op12_ranked_search.op12_ranked_search,
    "op13_html_text": op13_html_text.op13_html_text,
}

ORACLES = {
    "op1_decontamination": op01_decontamination.ORACLE,
    "op3_licenses": op03_licenses.ORACLE,
    "op4_simhash": op04_simhash.ORACLE,
    "op6_sharding": op06_sharding.ORACLE,
    "op7_chat": op07_chat.ORACLE,
    "op8_mixing": op08_mixing.ORACLE,
    "op9_warc": op09_warc.ORACLE,
    "op10_quality_rules": op10_quality_rules.ORACLE,
    "op12_ranked_search": op12_ranked_search.ORACLE,
    "op13_html_text": op13_html_text.ORACLE,
}
