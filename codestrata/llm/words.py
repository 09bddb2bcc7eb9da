"""Words of a text as a reader sees them."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a",
})
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}?>|<!--.*?-->", re.S)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]*)\)")
_MARK = re.compile(r"(?m)^[ \t]*(?:(?:>|\||#+|//+|/?\*+/?|--+|;+|%+|\+|-|=+|•|·|~)[ \t]*|\[\d{1,6}\][ \t]*|L?\d{1,6}(?:[:.)|>\]][ \t]*|[ \t]{2,}|\t)[ \t]*)+")
_HYPHEN = re.compile(r"[-‐‑](?<=\w.)[ \t]*\r?\n[ \t]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


class _Visible(dict):
    """Characters that a reader sees; the others are deleted. Filled as characters come up."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if unicodedata.category(c) in ("Mn", "Cf", "Me", "Cc") and c not in "\n\t\r" else code
        return self[code]


_VISIBLE = _Visible()


def reader_words(text: str | None) -> list[str]:
    """Lower-cased words without letter case, character forms, invisible characters, punctuation, markup, line breaks and line marks."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = text.translate(_VISIBLE)
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOKALIKES)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "\n" in text or not text[:1].isalpha():
        text = _HYPHEN.sub("", _MARK.sub("", text))
    return _WORD.findall(text)
