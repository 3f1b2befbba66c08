"""How far mining looks. Results beyond a limit are cut, and the unit says so (``cut``)."""

from __future__ import annotations

from dataclasses import dataclass


# The reach of blocks, comments and decorators in the map format.
@dataclass(frozen=True)
class Limits:
    """``None`` is no limit. ``block_lines``: lines of a block behind its first one;
    ``comment_chars``: characters of a comment; ``comment_lines``: lines of a block comment above a
    unit or on top of a file; ``signature_lines``: lines from a definition to the end of its
    signature, and from there to its docstring; ``docstring_lines``: lines of a docstring;
    ``decorator_lines``: lines from a decorator to what it decorates; ``unclosed_tag_chars``:
    characters of a route tag that never ends."""

    block_lines: int | None = 400
    comment_chars: int | None = 240
    comment_lines: int | None = 60
    signature_lines: int | None = 12
    docstring_lines: int | None = 30
    decorator_lines: int | None = 8
    unclosed_tag_chars: int | None = 500
# Fixed values end.


#: As good as no limit: a file has fewer lines.
UNLIMITED = 1 << 30


def lines_of(limit: int | None) -> int:
    return UNLIMITED if limit is None else limit


def stretches(limit: int | None, first: int = 12) -> list[int]:
    """Growing look-ahead lengths up to a limit: most ends are near, and looking again from the start
    costs less than a third of the last stretch."""
    out, most = [], lines_of(limit)
    while first < most:
        out.append(first)
        first *= 4 if first < 1 << 20 else 1 << 10
    return [*out, most]
