"""Registered queries of this folder, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from ledgerlens.llm import (
    chat, decontaminate, filter_audit, fm_quality, langid, packing, pii, quality, simhash, substrings, url_filters, warc, whitening,
)

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_packing": packing.op2_packing,
    "op3_pii": pii.op3_pii,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_simhash": simhash.op5_simhash,
    "op6_substrings": substrings.op6_substrings,
    "op7_warc": warc.op7_warc,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_whitening": whitening.op11_whitening,
    "op12_quality_fm": fm_quality.op12_quality_fm,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op3_pii": pii.ORACLE,
    "op6_substrings": substrings.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
