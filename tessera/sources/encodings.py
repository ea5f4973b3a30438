"""The encoding of a file's bytes: marks first, then what the bytes rule out, then how the text would look."""

from __future__ import annotations

import codecs
import re
import unicodedata

# Byte order marks and the codecs that read past them, the longer first.
MARKS = (
    (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"),
)
#: Bytes that no text has but in encodings of two or four bytes a character, or with shifts.
_CONTROLS = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
_BLOCKS = (("\x20", "\x7e"), ("\xa0", "\u017f"), ("\u0370", "\u04ff"), ("\u2010", "\u203a"), ("\u3000", "\u30ff"), ("\u4e00", "\u9fff"), ("\uac00", "\ud7a3"), ("\uff00", "\uffef"))
_SHIFTED = re.compile(rb"\x1b(?:\$[@B]|\([BJ])")
#: Encodings of several bytes a character, and the lead bytes of their everyday characters.
_MANY = (("cp932", (0x82, 0x83)), ("euc_jp", (0xA4, 0xA5)), ("euc_kr", (0xB0, 0xC8)), ("gb18030", (0xB0, 0xD7)), ("big5", (0xA4, 0xC6)))
#: Encodings of one byte a character, in the order in which ties are decided, and the script of the letters they add.
_ONE = (("cp1252", "LATIN"), ("cp1251", "CYRILLIC"), ("koi8_r", "CYRILLIC"), ("iso8859_5", "CYRILLIC"), ("cp1253", "GREEK"), ("cp1250", "LATIN"))
#: The most frequent small letters of a script, or of Latin beyond ASCII in western languages; for cp1250 those of central Europe.
_COMMON = {"CYRILLIC": set("оеаинтсрвлкмдпу"), "GREEK": set("αοιετσνηυρπκμλς"), "cp1252": set("éèàùâêîôûçäöüßñáíóúåøæ"), "cp1250": set("ąćęłńśźżčďěňřšťůžőűăţş")}


def _wide(data: bytes) -> str | None:
    """UTF-16 without a mark: read so, nearly all characters are of the blocks that texts are written in."""
    best = max(((_usual(text), codec) for codec in ("utf-16-le", "utf-16-be") if (text := _read(data, codec)) is not None), default=(0.0, None), key=lambda s: s[0])
    return best[1] if best[0] >= 0.9 else None


def _usual(text: str) -> float:
    return sum(c in "\t\n\r" or any(a <= c <= z for a, z in _BLOCKS) for c in text) / max(1, len(text))


def _read(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


def _script(text: str) -> dict[str, int]:
    """Characters beyond ASCII by the first word of their name."""
    out: dict[str, int] = {}
    for c in text:
        if c > "\x7f":
            kind = unicodedata.name(c, "NONE").split("-")[0].split(" ")[0]
            out[kind] = out.get(kind, 0) + 1
    return out


def _many(data: bytes, codec: str, lead: tuple[int, int]) -> float:
    """How much the bytes look like everyday text of an encoding of several bytes; -1: they break its rules."""
    text = _read(data, codec)
    if text is None or any(0x80 <= ord(c) < 0xA0 or 0xE000 <= ord(c) < 0xF900 for c in text):
        return -1.0
    wide = [c for c in text if c > "\x7f"]
    if not wide:
        return -1.0
    encoded = [c.encode(codec, "replace") for c in wide]
    pairs = [e for e in encoded if len(e) == 2]
    common = sum(lead[0] <= e[0] <= lead[1] for e in pairs)
    kinds = _script(text)
    total = len(wide)
    own = {"cp932": ("HIRAGANA", "KATAKANA"), "euc_jp": ("HIRAGANA", "KATAKANA"), "euc_kr": ("HANGUL",), "gb18030": ("CJK",), "big5": ("CJK",)}[codec]
    fits = sum(kinds.get(k, 0) for k in own) / total
    # half-width kana are what other encodings look like in Shift-JIS
    odd = kinds.get("HALFWIDTH", 0) / total + sum(len(e) != 2 for e in encoded) / total
    strange = sum(n for k, n in kinds.items() if k not in ("HIRAGANA", "KATAKANA", "HANGUL", "CJK", "IDEOGRAPHIC", "FULLWIDTH", "LEFT", "RIGHT", "HALFWIDTH", "MIDDLE", "HORIZONTAL", "EM", "EN")) / total
    return common / total + 0.5 * fits - 2 * odd - 2 * strange


def _one(data: bytes, codec: str, script: str) -> float:
    """The same for an encoding of one byte a character: letters of its script, common ones, in words of one case and one script."""
    text = _read(data, codec)
    if text is None:
        return -1.0
    high = [c for c in text if c > "\x7f"]
    letters = [c for c in high if c.isalpha() and unicodedata.name(c, "").startswith(script)]
    words = re.findall(r"[^\W\d_]+", text)
    broken = sum(1 for w in words if any(a.islower() and b.isupper() for a, b in zip(w, w[1:])) and any(c > "\x7f" for c in w))
    mixed = sum(1 for w in words if script != "LATIN" and any(c > "\x7f" for c in w) and any(c <= "\x7f" for c in w))
    touched = max(1, sum(any(c > "\x7f" for c in w) for w in words))
    common = _COMMON.get(codec) or _COMMON[script]
    usual = sum(c in common for c in letters)
    # a script of its own has most letters beyond ASCII, with Latin ones they are few among many
    share = len(letters) / max(1, sum(c.isalpha() for c in text))
    fits = share if script != "LATIN" else 1 - share
    signs = sum(not c.isalpha() and c not in "«»–—’‘“”„…°§€£№ " for c in high)
    return (len(letters) + usual - 2 * signs) / len(high) + 0.5 * fits - (broken + mixed) / touched


def detect(data: bytes) -> str:
    """The name of the codec that reads ``data``; of codecs that look as good the first in the order of this file's tables, and Latin-1 where none fits.

    Empty and plain ASCII text is UTF-8, and so is what is valid as such; bytes with control characters are no text of the old encodings.
    """
    for mark, codec in MARKS:
        if data.startswith(mark) and _read(data, codec) is not None:
            return codec
    if controls := [m.start() & 1 for m in _CONTROLS.finditer(data)]:
        valid = _read(data, "utf-8") is not None
        # halves of wide characters are many and on one side; a few stray ones are a part of the text
        stray = len(controls) < max(3, 0.1 * len(data)) or 0.1 < sum(controls) / len(controls) < 0.9
        if _SHIFTED.search(data) and _read(data, "iso2022_jp") is not None:
            return "iso2022_jp"
        if not (valid and stray) and (wide := _wide(data)):
            return wide
        return "utf-8" if valid else "latin-1"
    if _read(data, "utf-8") is not None:
        return "utf-8"
    # a few bytes prove little: the fewer, the more the first of the table is preferred
    doubt = 2 / sum(b > 0x7F for b in data)
    scores = [(_many(data, codec, lead), codec) for codec, lead in _MANY] + [(_one(data, codec, script) - (doubt if i else 0), codec) for i, (codec, script) in enumerate(_ONE)]
    best, codec = max(scores, key=lambda s: s[0])
    return codec if best > 0 else "latin-1"


def decode(data: bytes) -> str:
    """The text of ``data``; every input has one."""
    return data.decode(detect(data), "replace")
