"""Pieces of the SQL that queries are checked against."""

from __future__ import annotations

_BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_trim(expression: str) -> str:
    """``expression`` without leading and trailing Unicode white space."""
    return f"regexp_replace({expression}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def sql_list(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def finite(*columns: str) -> str:
    return " AND ".join(f"isfinite({c})" for c in columns)
