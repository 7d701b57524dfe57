"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_lm_score": "lm",
    "op2_near_dedup": "order_minhash",
    "op3_pii": "pii",
    "op4_toxicity": "toxicity",
    "op5_neighbours": "neighbours",
    "op6_decontaminate": "decontaminate",
    "op7_extract_html": "html_extract",
    "op8_warc": "warc",
    "op9_line_dedup": "line_dedup",
    "op10_mix_sources": "mixing",
}


def queries() -> dict:
    return {name: getattr(import_module(f"ledgerloom.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """For the others, tests compare with brute force."""
    from ledgerloom.llm.sql import ORACLES

    return dict(ORACLES)
