"""opN_ queries of this package and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from tidepanel.llm import anchors, chat, decontaminate, html, lines, packing, quality, simhash, suffixes, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_suffix_array_repeats": suffixes.op2,
    "op3_quality_rules": quality.op3,
    "op4_anchor_repeats": anchors.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_warc_revisits": warc.op6,
    "op7_line_dedup": lines.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_html_extraction": html.op9,
    "op10_chat_formatting": chat.op10,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.SQL,
    "op3_quality_rules": quality.SQL,
    "op6_warc_revisits": warc.SQL,
    "op10_chat_formatting": chat.SQL,
}
