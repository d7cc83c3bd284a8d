"""Link extraction as column expressions (JVM-side, no Python).

Two extractors with different rules, both kept:

* :func:`regex_links` - the per-line pattern of the bounded link-count job:
  lower-case ``<a``, upper-case ``HREF``, quoted value ending in ``.html``.
* :func:`html_links` - every ``<a>`` start tag of a whole document, ``href`` in
  any case, as an HTML parser sees it. One pattern cuts the document from left
  to right into comments, declarations, marked sections, processing
  instructions, end tags, scripts, styles and start tags, so what looks like a
  tag inside any of them (or inside an attribute's value) is none. Quoted or
  unquoted values, the last of repeated ``href`` attributes, character
  references resolved (:func:`decode_references`), empty values dropped.

A value that a later step names more than once is bound by a ``transform`` over
an array of one: interpreted lambdas evaluate what they name each time.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The link pattern of the line-based link counter (must stay as is).
LINE_LINK_PATTERN = r"""<a\s+[^>]*\bHREF=["']([^"']+\.html)["'][^>]*>"""
# Suffix that marks a page link; stripped to form the page id.
PAGE_SUFFIX = ".html"
# ---------------------------------------------------------------------------

# The rest of a start tag up to its '>'; a quote opens a value (which may hold
# '>') only after '='. Possessive runs keep the Java regex from deep
# backtracking on long documents.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
# The same for engines without possessive quantifiers.
_REST_PLAIN = r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*"""


def _markup(rest: str, no_slash: str) -> str:
    """One piece of markup; group 1 is an ``<a ...>`` start tag with attributes."""
    return "|".join([
        r"(?is)<!--.*?(?:--\s*>|\z)",                                # comment
        r"<!\[(?:if|else|endif)\b.*?(?:\]\s*>|\z)",                 # conditional section
        r"<!\[.*?(?:\]\s*\]\s*>|\z)",                              # CDATA and other sections
        r"<[!?/][^>]*(?:>|\z)",                                      # declaration, instruction, end tag
        *(rf"<{raw}(?:[\s/]{rest}{no_slash})?>.*?(?:</{raw}\s*>|\z)" for raw in ("script", "style")),
        rf"(<a[\s/]{rest}>)",
        rf"<[a-z]{rest}(?:>|\z)",  # what has no '>' runs to the end: nothing is scanned again
    ])


MARKUP = _markup(_REST, "(?<!/)")
MARKUP_PLAIN = _markup(_REST_PLAIN, "")
# One attribute: name, then an optional quoted or unquoted value.
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
# The same, with group 1 an attribute named href as a whole, for one pass.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
HREF_ATTRIBUTE = rf"""(?i)(href(?![^\s"'<>/=])(?:\s*+=\s*+{_VALUE})?+)|[^\s"'<>/=]++(?:\s*+=\s*+{_VALUE})?+"""
HREF_VALUE = r"""(?is)^href\s*=\s*(["']?)(.*?)\1$"""

# A character reference at the start of what follows an '&'.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = chr(0xFFFD)
# Names that may lack their semicolon, longest first: a name that is no
# reference may begin with one.
_BARE_NAMES = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)


def regex_links(text: Column) -> Column:
    """Array of ``.html`` targets matched by the line pattern in ``text``."""
    return F.regexp_extract_all(text, F.lit(LINE_LINK_PATTERN), F.lit(1))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _text_map(entries: dict[str, str]) -> Column:
    """A map literal (folded from JSON: thousands of literals make a slow plan)."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _numeric(code: Column) -> Column:
    """The text of a numeric reference: Windows-1252 for 0x80 to 0x9F, U+FFFD
    for zero, surrogates and what is beyond Unicode, nothing for other control
    characters and noncharacters."""
    windows = {str(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = ((code < 0x20) & ~code.isin(0x09, 0x0A, 0x0C, 0x0D)) | (code == 0x7F)
    none = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), REPLACEMENT)
            .when(code.between(0x80, 0x9F), _text_map(windows)[code.cast("string")])
            .when(control | none, "")
            .otherwise(wide))


def _number(digits: Column, base: int, longest: int) -> Column:
    """The number, or NULL if it has more digits than any code point."""
    bare = F.ltrim(digits, F.lit("0"))
    return bind(bare, lambda d: F.when(F.length(d) <= longest, F.conv(F.concat(F.lit("0"), d), base, 10).cast("bigint")))


def _reference(after: Column) -> Column:
    """What stands for an '&' and the text ``after`` it."""
    # by first letter: a lookup goes through a map's entries one after the other
    letters: dict[str, dict[str, str]] = {}
    for name, text in html.entities.html5.items():
        letters.setdefault(name[0], {})[name] = text
    names = F.from_json(F.lit(json.dumps(letters)), "map<string,map<string,string>>")

    def named_text(name: Column) -> Column:
        return names[F.substring(name, 1, 1)][name]

    def resolved(ref: Column) -> Column:
        prefix = F.regexp_extract(ref, "^(?:" + "|".join(_BARE_NAMES) + ")", 0)
        named = bind(named_text(ref), lambda whole: F.coalesce(whole, bind(prefix, lambda p: F.when(p == "", F.concat(F.lit("&"), ref)).otherwise(
            F.concat(named_text(p), F.substr(ref, F.length(p) + 1))))))
        number = (F.when(ref.rlike("^#[xX]"), _number(F.rtrim(F.substr(ref, F.lit(3)), F.lit(";")), 16, 6))
                  .otherwise(_number(F.rtrim(F.substr(ref, F.lit(2)), F.lit(";")), 10, 7)))
        return (F.when(ref == "", F.lit("&")).when(ref.startswith("#"), bind(number, _numeric)).otherwise(named))

    return bind(F.regexp_extract(after, REFERENCE, 1), lambda ref: F.concat(resolved(ref), F.substr(after, F.length(ref) + 1)))


def decode_references(value: Column) -> Column:
    """``value`` with its character references resolved in one pass from left
    to right: decimal, hexadecimal and named ones (the HTML set, with the names
    that may lack a semicolon), so ``&amp;lt;`` becomes ``&lt;``."""
    pieces = F.transform(F.split(value, "&"), lambda p, i: F.when(i == 0, p).otherwise(_reference(p)))
    return F.when(F.instr(value, "&") > 0, F.array_join(pieces, "")).otherwise(value)


def anchor_tags(document: Column) -> Column:
    """Array of ``<a ...>`` start tags, as one pass over all markup finds them."""
    return F.filter(F.regexp_extract_all(document, F.lit(MARKUP), F.lit(1)), lambda tag: tag != "")


def tag_href(tag: Column) -> Column:
    """The decoded value of the last ``href`` attribute of one start tag, or NULL."""
    attributes = F.regexp_extract_all(F.substr(tag, F.lit(3)), F.lit(HREF_ATTRIBUTE), F.lit(1))
    last = F.try_element_at(F.filter(attributes, lambda a: a != ""), F.lit(-1))
    return bind(F.regexp_extract(last, HREF_VALUE, 2), decode_references)


def html_links(document: Column) -> Column:
    """Array of non-empty ``href`` values of every ``<a>`` tag in ``document``."""
    return F.filter(F.transform(anchor_tags(document), tag_href),
                    lambda h: h.isNotNull() & (F.length(h) > 0))


def strip_suffix(name: Column, suffix: str = PAGE_SUFFIX) -> Column:
    """``name`` without ``suffix`` (the caller has checked that it ends with it)."""
    return name.substr(F.lit(1), F.length(name) - len(suffix))


def base_name(path: Column) -> Column:
    """Last path segment: ``gs://b/dir/12.html`` -> ``12.html``."""
    return F.substring_index(path, "/", -1)
