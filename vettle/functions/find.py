"""Patterns of the lexicon found in Python as Java finds them (see `lexicon.java`), for walks over documents.

A text is searched in its plain form, character for character: what is beyond ASCII becomes one of three signs (of a word,
white space, neither), but for the four letters that a pattern without case takes for ASCII ones. A pattern is tried only
where a literal stands that each of its matches begins with.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from vettle import lexicon as L

#: White space as Unicode has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{SPACE}]+")
_BEYOND = re.compile("[^\x00-\x7f]")
_LETTERS = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}


def in_word(c: str) -> bool:
    """Whether a character is of a word, as Unicode has it."""
    if c < "\x80":
        return c.isalnum() or c == "_"
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "Ⓐ" <= c <= "ⓩ" or "\U0001f130" <= c <= "\U0001f149" or "\U0001f150" <= c <= "\U0001f169" or "\U0001f170" <= c <= "\U0001f189"


@lru_cache(10_000)
def _sign(c: str) -> str:
    return _LETTERS.get(c) or ("\xa0" if c in SPACE else "é" if in_word(c) else "§")


def plain(text: str) -> str:
    return text if text.isascii() else _BEYOND.sub(lambda m: _sign(m[0]), text)


def compiled(pattern: str) -> re.Pattern:
    """The pattern for plain forms."""
    return re.compile(pattern.replace(r"\s", "[\t-\r \xa0]"), re.IGNORECASE)


def _longest(literals: list[str]) -> str:
    """A pattern for the longest of the literals at a place, letter by letter."""
    heads: dict[str, list[str]] = {}
    for x in literals:
        heads.setdefault(x[:1], []).append(x[1:])
    ends = heads.pop("", None) is not None
    said = "|".join(re.escape(c) + _longest(rest) for c, rest in sorted(heads.items()))
    return f"(?:{said})" + "?" * ends if said else ""


class Searches:
    """Patterns by key, found together in a plain form and its small letters."""

    def __init__(self, patterns: dict) -> None:
        self.whole = {key: compiled(p) for key, p in patterns.items()}
        by: dict[str, list] = {}
        for key, p in patterns.items():
            for b in L.begins(p):
                by.setdefault(b, []).append((key, self.whole[key].match))
        self.literals = re.compile(_longest(list(by)))
        #: with a literal found, those that it begins with are found too
        self.tried = {b: [x for i in range(1, len(b) + 1) for x in by.get(b[:i], ())] for b in by}

    def places(self, text: str, small: str) -> dict:
        """Where matches begin, in order, by the key of each pattern that is found."""
        out: dict = {}
        search, tried = self.literals.search, self.tried
        m = search(small)
        while m:
            at = m.start()
            for key, match in tried[m[0]]:
                if match(text, at):
                    out.setdefault(key, []).append(at)
            m = search(small, at + 1)
        return out

    def spans(self, key, text: str, places: dict) -> list[tuple[int, int]]:
        """A pattern's matches from left to right that don't overlap, of what `places` has."""
        out, end = [], 0
        for at in places.get(key, ()):
            if at >= end:
                end = self.whole[key].match(text, at).end()
                out.append((at, end))
        return out


_NOISE, _NOISY = compiled(L.NOISE), L.needed(L.NOISE)


def clean(text: str) -> str:
    """`text.clean` of one text."""
    p, parts, at = plain(text), [], 0
    small = p.lower()
    for i, j in (m.span() for m in _NOISE.finditer(p)) if any(x in small for x in _NOISY) else ():
        parts += [text[at:i], " "]
        at = j
    return "".join([*parts, text[at:]]) if at else text


def trim_ellipsis(text: str, n: int = 220) -> str:
    """`text.trim_ellipsis` of one text."""
    one = SPACES.sub(" ", text).strip(" ")
    return one if len(one) <= n else one[: n - 1].rstrip(" ") + "…"
