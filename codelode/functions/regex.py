"""Regular expressions with the whitespace and word rules of the map format.

The catalogue in ``operators.rules`` is written for an engine in which ``\\s`` covers
Unicode spaces and the byte-order mark, ``\\b`` looks at ASCII word characters only
and ``$`` matches at the very end of the text. Java's defaults differ, so patterns
pass through :func:`rx` before they become literals in a Spark expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_SPACE_CLASS = (
    r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def rx(pattern: str, *, multiline: bool = False, ascii_only: bool = False) -> str:
    """Java form of ``pattern``; see the module docstring. ``ascii_only``: the text is known
    to be ASCII, where Java's own white space class is the same and faster."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            if ascii_only and nxt in "sS":
                out.append(c + nxt)
            elif nxt == "s":
                out.append(_SPACE_CLASS if in_class else f"[{_SPACE_CLASS}]")
            elif nxt == "S":
                out.append(f"[^{_SPACE_CLASS}]")
            elif nxt == "b" and not in_class:
                follows_word = i + 2 < len(pattern) and (pattern[i + 2].isalnum())
                out.append(r"(?<!\w)" if follows_word else _WORD_EDGE)
            else:
                out.append(c + nxt)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            i += 1
            if i < len(pattern) and pattern[i] == "^":
                out.append("^")
                i += 1
            continue
        if c == "[":
            out.append("\\[")
        elif c == "&" and in_class:
            out.append("\\&")
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "$" and not in_class and not multiline:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def trim(col: Column) -> Column:
    """Trim every character that counts as white space in the map format."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def squeeze(col: Column) -> Column:
    """Runs of white space become one space; ends are trimmed. Visible ASCII is told first, as the class
    of white space takes many times as long for a character."""
    return trim(F.regexp_replace(col, "(?![!-~])" + rx(r"\s+"), " "))
