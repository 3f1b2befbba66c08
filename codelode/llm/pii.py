"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the
score.

The four base kinds follow fixed patterns, and what passes their checks is always reported; context
only changes its score. Further kinds (IBAN, secrets, phone numbers without a country, national
numbers) are reported from a score of ``THRESHOLD`` on, outside base spans. An IBAN has the length of
its country, whatever follows it. A secret is a long run of mixed characters that look random; it
needs a known beginning or a word nearby that says so.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from codelode.llm.common import with_text_columns

THRESHOLD = 0.6
#: Characters before and after a span in which context words count.
NEARBY = 40
CONTEXT_BONUS = 0.35
BASE = ("email", "ip", "card", "phone")
#: Kinds in the order of the report.
KINDS = (*BASE, "iban", "secret", "local_phone", "ssn")
#: Score of a confirmed span, and words that raise it.
SCORES = {"email": 0.95, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "secret": 0.4,
          "local_phone": 0.4, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write to"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("key", "token", "secret", "passw", "pwd", "credential", "auth", "bearer", "schlüssel",
               "passwort", "kennwort", "clé", "jeton", "clave", "contraseña"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "handy"),
    "ssn": ("ssn", "social security", "national id", "tax id")}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
#: Beginnings of well-known kinds of keys.
SECRET_BEGINNINGS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-",
                     "sk_live_", "rk_live_", "sk-", "xoxa-", "xoxb-", "xoxp-", "eyJ")
#: Characters of a secret, at least, and least bits of entropy of one.
SECRET_CHARS, SECRET_BITS = 20, 3.0

#: Patterns of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_IBAN_HEAD = re.compile(r"\b[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_SECRET = re.compile(rf"(?<![\w+/.-])[A-Za-z0-9+/_.-]{{{SECRET_CHARS},}}={{0,2}}(?![\w+/-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap: an address begins where the run of local characters
    before its @ does, or where the last address ended."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _matches(pattern: re.Pattern, text: str, check: Callable[[str], bool]) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if check(m[0])]


def _is_card(match: str) -> bool:
    digits = _digits(match)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(match: str) -> bool:
    return 9 <= len(_digits(match)) <= 15


def _is_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in _matches(_IP, text, _is_ip)]
        found += [("card", *s) for s in _matches(_CARD, text, _is_card)]
        found += [("phone", *s) for s in _matches(_PHONE, text, _is_phone)]
    return found


def _scored(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEARBY):end + NEARBY].lower()
    return min(1.0, SCORES[kind] + CONTEXT_BONUS * any(w in near for w in CONTEXT[kind]))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Places with a country's number of letters and digits, single spaces among them, a word's end
    behind them and a right checksum."""
    done = 0
    for m in _IBAN_HEAD.finditer(text):
        left, at = IBAN_LENGTHS.get(m[0][:2], 0) - 4, m.end()
        if left <= 0 or m.start() < done:
            continue
        while left and at < len(text):
            step = 1 + (text[at] == " ")
            if text[at + step - 1:at + step] not in _IBAN_CHARS:
                break
            at, left = at + step, left - 1
        if not left and not text[at:at + 1].isalnum() and mod97(text[m.start():at].replace(" ", "")):
            done = at
            yield m.start(), at


_IBAN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def entropy(text: str) -> float:
    """Bits of a character, by the frequencies of the text's own."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _looks_random(run: str) -> bool:
    """Letters and digits in one run, changing often, and of many kinds: no name, path or number."""
    kinds = ["d" if c.isdigit() else "l" if c.isalpha() else "" for c in run]
    turns = sum(bool(a and b) and a != b for a, b in zip(kinds, kinds[1:]))
    return turns >= max(4, len(run) / 6) and entropy(run) >= SECRET_BITS


def _covered(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the given places cover, as places in order that don't overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def spans(text: str | None) -> list[Span]:
    """All spans of a text by kind and start, in code points, ends exclusive."""
    if not text:
        return []
    base = base_spans(text)
    found = [Span(*s, _scored(text, *s)) for s in base]
    if not _DIGIT.search(text):
        return found
    taken = _covered((s, e) for _, s, e in base)
    proposed = {
        "iban": ibans(text),
        "secret": _matches(_SECRET, text, lambda run: run.startswith(SECRET_BEGINNINGS) or _looks_random(run)),
        "local_phone": _matches(_LOCAL_PHONE, text, lambda _: True),
        "ssn": _matches(_SSN, text, lambda _: True)}
    for kind, places in proposed.items():
        for start, end in places:
            score = _scored(text, kind, start, end)
            if kind == "secret" and text.startswith(SECRET_BEGINNINGS, start):
                score = min(1.0, score + CONTEXT_BONUS)
            at = bisect_left(taken, (end,))  # the places before it begin left of the end
            if score >= THRESHOLD and (at == 0 or taken[at - 1][1] <= start):
                taken.insert(at, (start, end))
                found.append(Span(kind, start, end, score))
    return found


def find_pii(docs: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, start, end, score). Null and empty texts have
    none; repeated rows give the same, no rows give no rows; a column ``pii`` is replaced."""
    return with_text_columns(
        docs, text_col, lambda: lambda texts: {"pii": [[s._asdict() for s in spans(t)] for t in texts]},
        "pii array<struct<kind:string,start:int,end:int,score:double>>", drop)


def _joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def _report(texts: list[str | None]) -> dict:
    rows = [spans(t) for t in texts]
    base = [[s for s in r if s.kind in BASE] for r in rows]
    return {f"n_{k}": [sum(s.kind == k for s in r) for r in rows] for k in KINDS} | {
        "n_spans": [len(r) for r in rows], "base_sha256": [hashlib.sha256(_joined(r).encode()).hexdigest() for r in base],
        "spans": [_joined(r) for r in rows]}


def pii_report(docs: DataFrame) -> DataFrame:
    return with_text_columns(
        docs.select("doc_id", "text"), "text", lambda: _report,
        ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long",
        ("text",))
