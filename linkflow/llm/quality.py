"""Operator 8, quality rules: line-first cleaning.

Each line with a word is judged alone; a line that fails a rule is taken out,
and a document that loses too much of its text is rejected as a whole:

- punctuation: more than ``max_symbol_share`` of the line's characters are of
  ``#*$%&|<>``;
- navigation: at least ``nav_items`` items between separators (``|``, ``>``,
  ``»``, ``·``), none longer than ``nav_words`` words;
- boilerplate: whole words of the fixed phrases are at least PHRASE_SHARE of
  the line's words (runs of letters and digits; a letter of a script without
  spaces is one), or an equal line stood before it. A line that only mentions
  a phrase stays.

``kept`` is false if the base rules fail (fewer than ``min_words`` words, or
over half of the words in repeated three-word windows) or the removed lines
hold more than ``max_lost`` of the word characters.

Defined results: a null or empty text has no words and is rejected; its
cleaned text is empty; repeated rows give one result each; an empty table none.
Result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import hold, mapped, sliced

_word = re.compile(r"[^\x20\x09-\x0D]+")
_symbol = re.compile(r"[#*$%&|<>]")
_separator = re.compile(r"[|>»·]")
# Phrases of lines that sites repeat.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "read more", "sign up", "log in", "subscribe to", "javascript is disabled", "share this", "lorem ipsum")
_boilerplate = re.compile(rf"\b(?:{'|'.join(map(re.escape, BOILERPLATE))})\b", re.IGNORECASE)
PHRASE_SHARE = 0.5
_unspaced = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff"
_phrase_word = re.compile(rf"[^\W{_unspaced}]+|[{_unspaced}]")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, total = 0, 0  # words before `covered` are counted
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def boilerplate(line: str) -> bool:
    """Whether the line is mostly fixed phrases."""
    own = sum(len(x.split()) for x in _boilerplate.findall(line))
    return own > 0 and own >= PHRASE_SHARE * len(_phrase_word.findall(line))


def bad_line(line: str, words: list[str], max_symbol_share: float, nav_items: int, nav_words: int) -> bool:
    if len(_symbol.findall(line)) > max_symbol_share * len(line) or boilerplate(line):
        return True
    items = _separator.split(line)
    return len(items) >= nav_items and all(len(_word.findall(x)) <= nav_words for x in items)


def judge(text: str, min_words: int, max_lost: float, **rules) -> tuple:
    words = _word.findall(text)
    chars, dup, lost, seen, left = sum(map(len, words)), 0, 0, set(), []
    for line in text.split("\n"):
        own = _word.findall(line)
        if own and line in seen:
            dup += 1
        if own and (line in seen or bad_line(line, own, **rules)):
            lost += sum(map(len, own))
        else:
            left.append(line)
        if own:
            seen.add(line)
    repeated = repeated_words(words)
    failed = len(words) < min_words or 100 * repeated > 50 * len(words)
    return len(words), chars, len(_symbol.findall(text)), dup, repeated, failed, not failed and lost <= max_lost * chars, "\n".join(left)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def quality(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_lost: float = 0.5, max_symbol_share: float = 0.25, nav_items: int = 4, nav_words: int = 3) -> DataFrame:
    """``docs`` with COLUMNS: the counts, the verdict and the text without the
    failed lines."""
    rules = {"max_symbol_share": max_symbol_share, "nav_items": nav_items, "nav_words": nav_words}

    def run(batches):
        hold()
        for b in sliced(batches):
            found = [judge(t or "", min_words, max_lost, **rules) for t in b.column(b.num_columns - 1).to_pylist()]
            columns = [*zip(*found)] or [()] * len(COLUMNS)
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()]
            arrays = [*b.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:-1], *COLUMNS])

    kept = [c for c in docs.columns if c not in COLUMNS]
    slim = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias("__judged"))
    schema = slim.drop("__judged").schema
    for c in COLUMNS:
        schema = schema.add(c, "boolean" if c in ("base_failed", "kept") else "string" if c == "clean_text" else "long")
    return mapped(slim, run, schema)


def clean_documents(docs: DataFrame, **rules) -> DataFrame:
    """The kept documents with their cleaned texts, in ``docs``' columns
    (``n_chars``, where there is one, counts the cleaned text)."""
    judged = quality(docs, **rules).where("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return judged.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))
