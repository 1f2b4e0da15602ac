"""All registered queries and their SQL twins."""

from __future__ import annotations

from checks import layout_checks, ocr_checks, stream_checks, text_checks, track_checks

MODULES = [text_checks, ocr_checks, layout_checks, track_checks, stream_checks]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
