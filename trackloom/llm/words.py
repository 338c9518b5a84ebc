"""Words of a text without case, punctuation, markup, entities or hyphenation."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|\]\([^()\s]+\)", re.S)
_GONE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff'\u2019\u02bc`\u00b4]")
_HYPHEN = re.compile(r"(?<=[^\W_])[-\u2010\u2011\u2012](?:\s*\n\s*)?(?=[^\W_])|(?<=[^\W_])[-\u2010\u2011\u2012][ \t]*\r?\n\s*(?=[^\W_])")
_MARK = re.compile("[\u0300-\u036f]+")
_WORD = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W_]+(?:[-\u2010\u2011\u2012][^\W_]+)+")


def _clean(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    return _GONE.sub("", text).lower()


def words(text: str | None) -> list[str]:
    """Lower-case words, hyphenated ones joined; null and blank texts have none."""
    if not text:
        return []
    text = _clean(text)
    if "-" in text or not text.isascii():
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text)


def compounds(text: str | None) -> set[tuple[str, ...]]:
    """Parts of the hyphenated words of a text."""
    return {tuple(_WORD.findall(m)) for m in _COMPOUND.findall(_clean(text))} if text else set()


class Joiner:
    """Joins words that a table of compounds knows as parts of one."""

    def __init__(self, parts: set[tuple[str, ...]]):
        self.heads: dict[str, list[tuple[str, ...]]] = {}
        for p in sorted(parts, key=lambda p: (-len(p), p)):
            self.heads.setdefault(p[0], []).append(p)
        self.first = frozenset(self.heads)

    def __call__(self, ws: list[str]) -> list[str]:
        if not self.first or self.first.isdisjoint(ws):
            return ws
        out, i = [], 0
        while i < len(ws):
            for p in self.heads.get(ws[i], ()):
                if tuple(ws[i : i + len(p)]) == p:
                    out.append("".join(p))
                    i += len(p)
                    break
            else:
                out.append(ws[i])
                i += 1
        return out
