"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, brown_lm, chat, crf, media, near_dup, packing, periodic, quality_rules, secret_scan, spelling, suffix_dedup, warc

QUERIES = {
    "op1_secrets": secret_scan.query,
    "op2_media_png": media.query,
    "op3_crf_quality": crf.query,
    "op4_brown_lm": brown_lm.query,
    "op5_packing": packing.query,
    "op6_warc": warc.query,
    "op7_bpe": bpe.query,
    "op8_quality_rules": quality_rules.query,
    "op9_chat": chat.query,
    "op10_near_dup": near_dup.query,
    "op11_spelling_variants": spelling.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_periodic_runs": periodic.query,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
}
