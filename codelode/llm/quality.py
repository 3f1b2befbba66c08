"""Quality rules, line by line: lines that fail a rule go, and a document that loses too much of its
text is rejected.

Rules of a line with at least one word:

* punctuation: it has a sentence mark of any script, if it is longer than a heading (scripts that
  write no such marks need none); symbols are few; words that shout (end in two exclamation marks)
  are few;
* navigation: separators are few among its words;
* boilerplate: it has none of a list of phrases.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from codelode.llm.common import with_text_columns

#: Words of a line that needs no sentence mark.
HEADING_WORDS = 8
#: A line fails with more than one symbol for so many characters of words.
CHARS_PER_SYMBOL = 10
#: A line fails with one shouting word, or one separator, for so many words or fewer (and 3 at least).
WORDS_PER_SHOUT = 4
WORDS_PER_SEPARATOR = 6
#: A document is rejected if more than this share of its words' characters goes.
MOST_LOST = 0.5
#: Marks that end or part sentences, by script.
MARKS = (".!?…:;‼‽⁇⁈⁉" "。！？：；．｡" "।॥" "؟۔؛" "։" "።፣፤፧" "។៕៖" "၊။" "།༎" "᠃᠉")
#: First and last letters of scripts without such marks (Thai, Lao).
MARKLESS = ("\u0e01", "\u0edf")
#: Fixed values, in lower case.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "privacy policy",
    "terms of use", "terms of service", "cookie policy", "enable javascript",
    "subscribe to our newsletter", "click here",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation",
    "mentions légales", "activez javascript", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen",
    "allgemeine geschäftsbedingungen", "javascript aktivieren", "klicken sie hier", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "términos de uso",
    "condiciones de uso", "aviso legal", "active javascript", "haga clic aquí")
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "·", "•", "/", ">")
MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "lost_chars long, base_failed boolean, kept boolean")

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(f"[{re.escape(MARKS)}{MARKLESS[0]}-{MARKLESS[1]}]")


def n_symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def line_fails(line: str, words: list[str]) -> bool:
    n = len(words)
    if n > HEADING_WORDS and not _MARK.search(line):
        return True
    if n_symbols(line) * CHARS_PER_SYMBOL > sum(map(len, words)):
        return True
    shouts = sum(w.endswith("!!") for w in words) if "!!" in line else 0
    if shouts >= 3 and shouts * WORDS_PER_SHOUT >= n:
        return True
    bars = sum(map(words.count, SEPARATORS))
    if bars >= 3 and bars * WORDS_PER_SEPARATOR >= n:
        return True
    low = line.lower()
    return any(p in low for p in PHRASES)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 5-word window which the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = end = 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            total += at + WINDOW - max(at, end)
            end = at + WINDOW
    return total


def measure(text: str | None) -> tuple[str | None, dict]:
    """The text without its failing lines, and the columns of a document."""
    whole = text or ""
    seen: set[str] = set()
    words: list[str] = []
    kept: list[str] = []
    again = lost = 0
    for line in whole.split("\n"):
        own = _WORDS.findall(line)
        if own:
            again += line in seen
            seen.add(line)
            words += own
            if line_fails(line, own):
                lost += sum(map(len, own))
                continue
        kept.append(line)
    chars, repeated = sum(map(len, words)), repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    return (text if text is None or not lost else "\n".join(kept)), {
        "n_words": len(words), "word_chars": chars, "n_symbols": n_symbols(whole),
        "n_dup_lines": again, "n_repeat_words": repeated, "lost_chars": lost,
        "base_failed": failed, "kept": not failed and lost <= MOST_LOST * chars}


def _columns(texts: list[str | None]) -> dict:
    rows = [measure(t) for t in texts]
    return {"clean_text": [t for t, _ in rows]} | {
        c.split()[0]: [r[c.split()[0]] for _, r in rows] for c in COLUMNS.split(", ")}


def quality(docs: DataFrame, text_col: str = "text", clean: bool = True) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``kept`` and (unless ``clean`` is false, then without
    the text) ``clean_text``.

    A null or empty text has no words and fails. Repeated rows are judged alike, an empty table
    gives no rows; columns of ``docs`` with the names of new ones are replaced.
    """
    def make():
        if clean:
            return _columns
        return lambda texts: {k: v for k, v in _columns(texts).items() if k != "clean_text"}

    return with_text_columns(docs, text_col, make, ("clean_text string, " if clean else "") + COLUMNS,
                             () if clean else (text_col,))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines. ``n_chars``, where there is such a
    column, counts the new text."""
    columns = docs.columns
    named = {c: f"__in{i}" for i, c in enumerate(columns)}
    judged = quality(docs.withColumnsRenamed(named), named[text_col]).where("kept")
    out = {c: F.col(n) for c, n in named.items()}
    out[text_col] = F.col("clean_text")
    if "n_chars" in out:
        out["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[v.alias(c) for c, v in out.items()])


def quality_report(docs: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text"), clean=False).drop("lost_chars")
