"""Shell commands without what is only text in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _here(dash: str, tabs: str, group: int) -> str:
    """A here-document: its opening line, its marker, and the closing line where there is one."""
    opening = rf"(<<{dash}[ \t]*[\"']?([A-Za-z0-9_]+)[^\n]*(?:\n|\z))"
    return rf"{opening}(?:[\s\S]*?(?<=\n)({tabs}\{group}(?:\n|\z))|[\s\S]*)"


QUOTED = "|".join((_here("", "", 2), _here("-", r"\t*", 5), r"'[^']*(?:'|\z)", r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\\?(?:"|\z)'))


def outside_quotes(command: Column) -> Column:
    """The command without quoted strings and bodies of here-documents; the lines that open and close these stay.

    In double quotes a backslash keeps the next character from closing them. A dash before the marker lets tabs stand
    before the closing one. What isn't closed reaches to the end. A null command gives null."""
    return F.regexp_replace(command, QUOTED, "$1$3$4$6")
