"""Character functions over codepoints, as Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of character classes, and families of them.
CLASSES = {
    "SPACE": 1 << 0, "IDEOGRAPHIC_PUNC": 1 << 1, "KANJI": 1 << 2, "FIGURE": 1 << 3, "PERIOD": 1 << 4,
    "MIDDLE_DOT": 1 << 5, "COMMA": 1 << 6, "ALPH": 1 << 7, "SYMBOL": 1 << 8, "KATAKANA": 1 << 9,
    "HIRAGANA": 1 << 10, "KANJI_FIGURE": 1 << 11, "SLASH": 1 << 12, "COLON": 1 << 13, "ERA": 1 << 14,
    "CHOON": 1 << 15, "HANKAKU_KANA": 1 << 16, "BRACKET": 1 << 17, "FIGURE_EXCEPTION": 1 << 18,
    "FIGURE_DIGIT": 1 << 19, "SMALL_KANA": 1 << 20,
}


def _family(*names: str) -> int:
    return sum(CLASSES[n] for n in names)


FAMILIES = {
    "FAMILY_FIGURE": _family("FIGURE", "PERIOD", "MIDDLE_DOT", "KANJI_FIGURE", "SLASH", "COLON"),
    "FAMILY_PUNC": _family("PERIOD", "COMMA", "IDEOGRAPHIC_PUNC"),
    "FAMILY_ALPH_PUNC": _family("ALPH", "PERIOD", "SLASH", "COLON", "MIDDLE_DOT"),
    "FAMILY_NUM_PERIOD": _family("PERIOD", "MIDDLE_DOT"),
    "FAMILY_PUNC_SYMBOL": _family("PERIOD", "COMMA", "IDEOGRAPHIC_PUNC", "MIDDLE_DOT", "SYMBOL", "SLASH", "COLON"),
    "FAMILY_SPACE": _family("SPACE"),
    "FAMILY_SYMBOL": _family("SYMBOL"),
    "FAMILY_ALPH": _family("ALPH"),
    "FAMILY_KANJI": _family("KANJI", "KANJI_FIGURE"),
    "FAMILY_KANA": _family("KATAKANA", "HIRAGANA", "HANKAKU_KANA", "SMALL_KANA"),
    "FAMILY_DOUBLE": _family("KATAKANA", "HIRAGANA", "HANKAKU_KANA", "SMALL_KANA", "KANJI", "CHOON"),
    "FAMILY_BRACKET": _family("BRACKET"),
    "FAMILY_DIGITS": _family("FIGURE", "KANJI_FIGURE", "FIGURE_DIGIT"),
    "FAMILY_EXCEPTION": _family("FIGURE", "KANJI_FIGURE", "FIGURE_EXCEPTION"),
    "FAMILY_PROLONGABLE": _family("KANJI", "HIRAGANA", "KATAKANA"),
    "FAMILY_FULL_KANA": _family("HIRAGANA", "KATAKANA"),
    "FAMILY_OTHERS": 0,
    "FAMILY_ANYTHING": 0x7FFFFFFF,
}

#: Brackets as ranges of codepoints, small kana, signs that prolong.
BRACKETS = (
    (0x28, 0x29), 0x5B, 0x5D, 0x7B, 0x7D, (0xF3A, 0xF3D), (0x169B, 0x169C), (0x2045, 0x2046), (0x207D, 0x207E),
    (0x208D, 0x208E), (0x2308, 0x230B), (0x2329, 0x232A), (0x2768, 0x2775), (0x27C5, 0x27C6), (0x27E6, 0x27EF),
    (0x2983, 0x2998), (0x29D8, 0x29DB), (0x29FC, 0x29FD), (0x2E22, 0x2E29), (0x3008, 0x3011), (0x3014, 0x301B),
    (0xFE59, 0xFE5E), (0xFF08, 0xFF09), 0xFF3B, 0xFF3D, 0xFF5B, 0xFF5D, (0xFF5F, 0xFF60), (0xFF62, 0xFF63),
)
SMALL_HIRAGANA, SMALL_KATAKANA = "ぁぃぅぇぉっゃゅょゎゕゖ", "ァィゥェォッャュョヮヵヶ"
PROLONGING = "ー〜～∼"

#: What a codepoint is: the first entry whose ranges hold it.
RULES = (
    (("SPACE",), (0x20, 0x3000, 0xA0, 0x1680, 0x180E, 0x202F, 0x205F, 0xFEFF, (0x2000, 0x200B))),
    (("IDEOGRAPHIC_PUNC",), ((0x3001, 0x3002),)),
    (("SYMBOL", "ERA"), ((0x337B, 0x337E),)),
    (("HIRAGANA", "SMALL_KANA"), tuple(map(ord, SMALL_HIRAGANA))),
    (("HIRAGANA",), ((0x3040, 0x309F),)),
    (("KATAKANA", "SMALL_KANA"), tuple(map(ord, SMALL_KATAKANA))),
    (("KATAKANA",), ((0x30A0, 0x30FA), (0x30FD, 0x30FF))),
    (("HIRAGANA", "KATAKANA", "CHOON"), tuple(map(ord, PROLONGING))),
    (("HANKAKU_KANA", "CHOON"), (0xFF70,)),
    (("HANKAKU_KANA",), ((0xFF66, 0xFF9F),)),
    (("MIDDLE_DOT",), (0xB7, 0x30FB)),
    (("COMMA",), (0x2C, 0xFF0C)),
    (("SLASH",), (0x2F, 0xFF0F)),
    (("COLON",), (0x3A, 0xFF1A)),
    (("PERIOD",), (0xFF0E,)),
    (("FIGURE",), ((0x30, 0x39), (0xFF10, 0xFF19))),
    (("KANJI_FIGURE", "KANJI"), tuple(map(ord, "○〇零一二三四五六七八九"))),
    (("FIGURE_EXCEPTION", "KANJI"), tuple(map(ord, "数何幾"))),
    (("KANJI_FIGURE", "FIGURE_DIGIT"), tuple(map(ord, "十百千万億兆"))),
    (("ALPH",), ((0x40, 0x5B), (0x60, 0x7B), (0xBF, 0x100), (0xFF20, 0xFF3B), (0xFF40, 0xFF5B), (0x370, 0x3FF), (0x400, 0x4FF))),
    (("KANJI",), ((0x4E00, 0x9FFF), 0x3005)),
    (("BRACKET",), BRACKETS),
)


def _class_table() -> np.ndarray:
    """Class bits of each codepoint below 2^16."""
    out = np.full(1 << 16, -1, np.int64)
    for names, ranges in RULES:
        for r in ranges:
            some = out[r[0] : r[1] + 1] if isinstance(r, tuple) else out[r : r + 1]
            some[some < 0] = _family(*names)
    out[out < 0] = CLASSES["SYMBOL"]
    return out


_TABLE = _class_table()


def classes_of(codes: np.ndarray) -> np.ndarray:
    """Class bits of codepoints, for whole batches."""
    return np.where(codes < 1 << 16, _TABLE[np.where(codes < 1 << 16, codes, 0)], CLASSES["SYMBOL"])


def class_sql(code: str) -> str:
    """SQL for the class bits of the codepoint `code`; both Spark and DuckDB run it."""
    cases = []
    for names, ranges in RULES:
        tests = [f"{code} BETWEEN {r[0]} AND {r[1]}" if isinstance(r, tuple) else f"{code} = {r}" for r in ranges]
        cases.append(f"WHEN {' OR '.join(tests)} THEN {sum(CLASSES[n] for n in names)}")
    return f"CASE {' '.join(cases)} ELSE {CLASSES['SYMBOL']} END"


def char_class(ch: Column) -> Column:
    """Class bits of a one-character string; 0 if it is empty, null if null."""
    code = F.ascii(ch)
    out = F.when(F.length(ch) == 0, 0)
    for names, ranges in RULES:
        some = [code.between(*r) if isinstance(r, tuple) else code == r for r in ranges]
        test = some[0]
        for s in some[1:]:
            test = test | s
        out = out.when(test, sum(CLASSES[n] for n in names))
    return F.when(ch.isNotNull(), out.otherwise(CLASSES["SYMBOL"]))


def class_by_name(name: str) -> int:
    """Bits of a class, or classes joined by `|`; unknown names are 0."""
    known = CLASSES | FAMILIES
    bits = 0
    for n in name.upper().split("|"):
        bits |= known.get(n.strip(), 0)
    return bits


def has_class(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(class_by_name(name))) != 0


def codepoint_at(text: Column, start: Column, end: Column, k: int) -> Column:
    """The k-th codepoint after (k > 0) or before (k < 0) a word; -1 out of range."""
    if k == 0:
        raise ValueError("k counts from 1 on either side")
    at = end + k if k > 0 else start + k + 1
    return F.when((at >= 1) & (at <= F.char_length(text)), F.ascii(F.substring(text, at, F.lit(1)))).otherwise(-1)


def class_around(text: Column, start: Column, end: Column, k: int) -> Column:
    """Its class, 0 out of range; for k = 0 the word's classes together."""
    if k == 0:
        chars = F.split(F.substring(text, start + 1, end - start), "")
        return F.aggregate(chars, F.lit(0), lambda a, c: a.bitwiseOR(char_class(c)))
    at = end + k if k > 0 else start + k + 1
    return F.when((at >= 1) & (at <= F.char_length(text)), char_class(F.substring(text, at, F.lit(1)))).otherwise(0)
