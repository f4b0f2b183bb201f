"""Identifiers: folding, quoting, names of targets."""

from __future__ import annotations

import re
from functools import lru_cache

#: Reserved words of the PostgreSQL family, which must be quoted as identifiers.
RESERVED = frozenset(
    """all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create
    current_catalog current_date current_role current_time current_timestamp current_user default deferrable desc
    distinct do else end except false fetch for foreign from grant group having in initially intersect into lateral
    leading limit localtime localtimestamp not null offset on only or order placing primary references returning
    select session_user some symmetric table then to trailing true union unique user using variadic when where
    window with""".split()
)
_PLAIN = re.compile(r"[a-z_][a-z0-9_]*")

#: Dialects of DDL text and the character they quote with.
QUOTES = {"postgres": '"', "oracle": '"', "mysql": "`", "spark": "`", "mssql": "]"}


def fold(name: str, preserve_case: bool = False) -> str:
    return name if preserve_case else name.lower()


def quoted(name: str, dialect: str = "postgres") -> str:
    """A name quoted where the dialect needs it: always, but for plain lower-case names of the PostgreSQL family."""
    if dialect == "postgres" and _PLAIN.fullmatch(name) and name not in RESERVED:
        return name
    q = QUOTES[dialect]
    return f"{'[' if q == ']' else q}{name.replace(q, q + q)}{q}"


@lru_cache(4096)
def ident(name: str, preserve_case: bool = False, dialect: str = "postgres") -> str:
    """A name folded (Oracle's keep their case) and quoted."""
    return quoted(name if dialect == "oracle" else fold(name, preserve_case), dialect)


def qualified(name: str, preserve_case: bool = False, dialect: str = "postgres") -> str:
    return ".".join(ident(part, preserve_case, dialect) for part in name.split("."))


def effective_case(preserve_case: bool, dialect: str) -> bool:
    """Whether names keep their case in comparisons: always on an Oracle target."""
    return preserve_case or dialect == "oracle"


def unique_names(pairs: list[tuple[str, str]]) -> list[str]:
    """A name for each (table, name), unique in all: the table in front of a repeated one, then a number."""
    seen, out = set(), []
    for table, name in pairs:
        options = [name, f"{table}_{name}"]
        n = 2
        while options[0] in seen:
            options.pop(0)
            if not options:
                options.append(f"{table}_{name}_{n}")
                n += 1
        seen.add(options[0])
        out.append(options[0])
    return out
