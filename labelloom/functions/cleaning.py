"""Remove the parts of a newsgroup post that give its label away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import WHITESPACE, strip_spaces

# What marks a line as quoted or as introducing a quotation.
QUOTE_LINE = r"writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>"

_INLINE = "[" + WHITESPACE.replace("\n", "") + "]*+"
# Greedy head, so the match is at the last blank-or-dashes line; DOTALL, whole
# text. The line itself is matched possessively: long runs cost one look each.
_FOOTER = rf"(?s)\A(.*)\n{_INLINE}-*+{_INLINE}(?:\n.*)?\z"


def strip_header(text: Column) -> Column:
    """What follows the first empty line; a text without one has no body."""
    at = F.instr(text, "\n\n")
    body = F.substring(text, at + 2, F.length(text))
    return F.when(at > 0, body).when(text.isNotNull(), F.lit(""))


def strip_footer(text: Column) -> Column:
    """Cut at the last line that is blank or dashes, unless it is the first line."""
    head = F.regexp_extract(strip_spaces(text), _FOOTER, 1)
    return F.when(head == "", text).otherwise(head)


def strip_quotes(text: Column) -> Column:
    """Drop quoted lines and the lines that introduce them."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(QUOTE_LINE))
    return F.array_join(kept, "\n")


_STEPS = {"headers": strip_header, "footers": strip_footer, "quotes": strip_quotes}


def strip_parts(text: Column | str, remove: tuple[str, ...] = ("headers", "footers", "quotes")) -> Column:
    """Apply the chosen removals, always in the order headers, footers, quotes."""
    unknown = set(remove) - set(_STEPS)
    if unknown:
        raise ValueError(f"unknown parts to remove: {sorted(unknown)}")
    out = F.col(text) if isinstance(text, str) else text
    for name, step in _STEPS.items():
        if name in remove:
            out = step(out)
    return out
