"""DuckDB text of the canonical rendering, for the oracle queries."""

from __future__ import annotations

NULL = "chr(0) || '\\N' || chr(0)"


def number(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def double(c: str, scale: int = 4) -> str:
    plain = f"regexp_replace(regexp_replace(CAST(CAST({c} AS DECIMAL(38, {scale})) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    return f"(CASE WHEN {plain} = '-0' THEN '0' ELSE {plain} END)"


def string(c: str) -> str:
    return f"(CASE WHEN regexp_full_match({c}, '\\\\x([0-9A-Fa-f]{{2}})+') THEN chr(0) || 'BIN' || chr(0) || lower(substr({c}, 3)) ELSE {c} END)"


def timestamp(c: str) -> str:
    micros = f"CASE WHEN date_part('microsecond', {c})::BIGINT % 1000000 = 0 THEN '' ELSE '.' || lpad((date_part('microsecond', {c})::BIGINT % 1000000)::VARCHAR, 6, '0') END"
    return f"(chr(0) || 'TS' || chr(0) || strftime({c}, '%Y-%m-%d %H:%M:%S') || {micros})"


def boolean(c: str) -> str:
    return f"CAST(CAST({c} AS INTEGER) AS VARCHAR)"


def binary(c: str) -> str:
    return f"(chr(0) || 'BIN' || chr(0) || lower(hex({c})))"


OF = {"n": number, "d": double, "s": string, "t": timestamp, "b": boolean, "x": binary}


def digest(**columns: str) -> str:
    """sha256 of the framed columns; each given as name=kind, a letter of OF."""
    parts = []
    for name, kind in columns.items():
        t = f"coalesce({OF[kind](name)}, {NULL})"
        parts.append(f"CAST(octet_length(encode({t})) AS VARCHAR) || chr(1) || {t}")
    return f"sha256({' || '.join(parts)})"
