"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: name of the query: its module
_WHERE = {
    "op1_license_scan": "licenses",
    "op2_url_filter": "url_filter",
    "op3_bpe_codec": "bpe_codec",
    "op4_collision_ann": "ann",
    "op5_line_dedup": "line_dedup",
    "op6_warc_revisits": "warc",
    "op7_packing": "packing",
    "op8_edit_counts": "edit_counts",
    "op9_quality_rules": "quality",
    "op10_ngram_join": "ngram_join",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in dict.fromkeys(_WHERE.values()):
        out.update(getattr(import_module(f"{__package__}.{module}"), "SQL", {}))
    return out
