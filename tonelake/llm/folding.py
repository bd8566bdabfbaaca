"""What a reader sees of a text, whatever its typography, accents, markup or character encoding."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t",
}
_LOOK = str.maketrans(LOOKALIKES)
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_BLOCK = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|th|table|h[1-6]|html|body|head|blockquote|pre|hr|section|article|title)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2})+")
#: A run of characters that bytes of UTF-8 become when they are read as a one-byte encoding.
_MISREAD = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")
_BROKEN_LINE = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_QUOTE_MARK = re.compile(r"(?m)^[ \t]*(?:>[ \t]*)+")
_EMPHASIS = re.compile(r"[*`~]+")
_APOSTROPHES = re.compile("['’‘ʼ`´]")
_WORD = re.compile(r"[^\W_]+")


def _bytes_of(s: str) -> bytes:
    out = bytearray()
    for ch in s:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            out += ch.encode("latin-1", "replace")
    return bytes(out)


def _reread(m: re.Match) -> str:
    try:
        return _bytes_of(m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def _from_hex(m: re.Match) -> str:
    raw = bytes.fromhex(re.sub("[%=]", "", m[0]))
    if m[0][0] == "%" and len(raw) == 1 and m.start() and m.string[m.start() - 1].isdigit() and " " in m.string:
        return m[0]  # a share in plain text, as in `5%20 dB` or `100%de`
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@lru_cache(maxsize=65536)
def fold_word(w: str) -> str:
    """A word in lower case without accents; look-alike letters become Latin in words that then are Latin only."""
    if w.isascii():
        return w.lower()
    w = "".join(ch for ch in unicodedata.normalize("NFKD", w) if not unicodedata.combining(ch)).casefold()
    if not w.isascii():
        looked = w.translate(_LOOK)
        if looked.isascii():
            return looked
    return w


def _without_comments(text: str) -> str:
    """Comments of any length taken away, in one scan; an open one stays."""
    out, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        out.append(text[at:begin])
        at = end + 3
    return "".join([*out, text[at:]])


def decode_marks(text: str) -> str:
    """Entities, escapes, misread bytes and markup resolved; line breaks kept."""
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)), text).replace("\\n", "\n").replace("\\t", " ").replace('\\"', '"').replace("\\/", "/")
    if "%" in text and _PERCENT.search(text):
        text = _PERCENT.sub(_from_hex, text)
        if "+" in text and " " not in text.strip():
            text = text.replace("+", " ")
    if "=" in text and ("=\n" in text or "=20" in text or _QUOTED.search(text)):
        text = _QUOTED.sub(_from_hex, text.replace("=\r\n", "").replace("=\n", ""))
    for _ in range(2):
        if not text.isascii() and _MISREAD.search(text):
            text = _MISREAD.sub(_reread, text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", _without_comments(text)))
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    return text


def readable(text: str | None) -> str:
    """The text as read: marks decoded, lines broken inside words joined, quote marks of lines gone, compatibility forms plain."""
    if not text:
        return ""
    text = decode_marks(text)
    if "\n" in text:
        text = _BROKEN_LINE.sub("", _QUOTE_MARK.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text


def words(text: str | None) -> list[str]:
    """The folded words of a text, in order; apostrophes and emphasis marks inside words are dropped."""
    text = _APOSTROPHES.sub("", _EMPHASIS.sub("", readable(text)))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)))
    return [fold_word(w) for w in _WORD.findall(text)]
