"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from kantar.llm import (
    chat_format,
    decontaminate,
    fill_in_middle,
    filter_audit,
    html_extract,
    knn_join,
    line_dedup,
    mixing,
    quality_gam,
    secrets,
    simhash,
    suffix_dedup,
    token_files,
)


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_voronoi_knn": knn_join.op2_voronoi_knn,
        "op3_simhash": simhash.op3_simhash,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_quality": quality_gam.op7_quality,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_html_extract": html_extract.op10_html_extract,
        "op11_token_files": token_files.op11_token_files,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.OP1_SQL,
        "op2_voronoi_knn": knn_join.OP2_SQL,
        "op9_chat_format": chat_format.OP9_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }
