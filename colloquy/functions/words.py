"""Words as defined by the project: NFKC, no invisible format characters, no case, runs of letters, marks and digits."""

from __future__ import annotations

import unicodedata

import regex

from colloquy.functions.lazy import arrow

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_FORMAT = regex.compile(r"\p{Cf}+")
_MARK = regex.compile(r"\p{M}+")


def folded(text: str) -> str:
    """NFKC without invisible format characters and without case."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", _FORMAT.sub("", unicodedata.normalize("NFKC", text)).casefold())


def words(text: str | None, accents: bool = True) -> list[str]:
    """The words of a text in order; none for null. ``accents=False`` drops combining marks too."""
    if not text:
        return []
    text = folded(text)
    if not accents and not text.isascii():
        text = unicodedata.normalize("NFC", _MARK.sub("", unicodedata.normalize("NFD", text)))
    return _WORD.findall(text)


@arrow("array<string>")
def words_of(texts: list) -> list:
    """Column form of ``words``."""
    return [words(t) for t in texts]


@arrow("array<string>")
def plain_words_of(texts: list) -> list:
    """Column form of ``words`` without accents."""
    return [words(t, accents=False) for t in texts]
