"""Byte-level BPE vocabularies (tokenizers JSON) and their pre-tokenisation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

from linkflow.llm.common import MEMO_ENTRIES, Memo

# Fixed values of the byte-level format: the split pattern, and white space as
# that pattern's \s has it (Unicode White_Space).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

_split = regex.compile(SPLIT.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def byte_chars() -> list[str]:
    """The printable character that the format writes for each byte: itself
    where Latin-1 prints it, else the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocab:
    """``tokens`` bytes by id, ``ranks`` (left id << 32 | right id) -> rank,
    ``made`` id by rank, ``parts`` id -> (left, right, rank), ``byte_ids`` by byte, ``special``
    string -> id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        byte_of = {ord(c): b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            if token not in self.special:
                self.tokens[i] = bytes(byte_of[ord(c)] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = [ids[c] for c in chars]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = ids[left + right]
            self.ranks[ids[left] << 32 | ids[right]] = rank
            self.made.append(new)
            self.parts.setdefault(new, (ids[left], ids[right], rank))
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def runs(self, text: str) -> list[str]:
        """The text cut at special strings; every second run is one."""
        return self._cut.split(text) if self._cut else [text]


_adjacent = re.compile(f"[{SPACE}][{SPACE}]")


def words(text: str) -> list[str]:
    """The pre-tokens of a text without special strings."""
    body = text[1:] if text[:1] == " " else text
    if body.isalpha() and max(body) < "ɐ":  # letters that no Unicode version has changed
        return [text]
    return _split.findall(text)


class ByPiece:
    """Values of a text's pre-tokens, looked up by the pieces between spaces
    and line ends. Where no two white-space characters adjoin, a line end is a
    pre-token and a space leads the piece after it, so pieces stand alone."""

    def __init__(self, of_word: Callable, add: Callable, pieces: int = MEMO_ENTRIES):
        self.by_word = Memo(of_word, entries=pieces // 4)
        self.add = add
        self.first, self.later = Memo(self.whole, entries=pieces // 8), Memo(lambda p: self.whole(" " + p), entries=pieces)

    def whole(self, text: str):
        return self.add(map(self.by_word.__getitem__, words(text)))

    def values(self, text: str) -> list:
        if _adjacent.search(text):
            return [self.by_word[w] for w in words(text)]
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.by_word["\n"])
            first, *later = line.split(" ")
            out.append(self.first[first])
            out += map(self.later.__getitem__, later)
        return out


def vocab(path: str) -> Vocab:
    return Vocab(path)
