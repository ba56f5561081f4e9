"""Kana and number normalisation as Columns: what a character may be read as."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.chars import char_class, class_by_name, classes_of

#: The vowel that prolongs a kana, and small kana with their large ones.
PROLONGED = {
    "あ": "かがばまゃ",
    "い": "いきしちにひじけせへめれげぜでべぺえね",
    "う": "くすつふゆぐずぷゅおこそとのほもよろごぞどぼぽょ",
}
PROLONGED_E = "えけげせぜてでねへべめれ"
SMALL, LARGE = "ぁぃぅぇぉゎヶケ", "あいうえおわケヶ"
#: Kana after which a small vowel may go.
BEFORE_SMALL = {"ぁ": "かさたなはまやらわがざだばぱ", "ぃ": "いしにりぎじねれぜ", "ぅ": "うくすふむるよ", "ぇ": "けせてめれぜで", "ぉ": "こそのもよろぞど"}
#: Flags of an alternative, and of a spelling that holds some.
ORIGINAL, REPLACE_SMALL, REPLACE, DELETE, REPLACE_PROLONG, DELETE_LAST, DELETE_PROLONG, DELETE_TSU, DELETE_SMALL, E_ROW = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512


def _is(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(class_by_name(name))) != 0


def replacements(ch: Column, before: Column, cls: Column) -> Column:
    """array<struct<alt, flag>> of what ch, of class cls and after `before`, may stand for."""
    vowel = F.lit(None).cast("string")
    for v, of in PROLONGED.items():
        vowel = F.when(F.contains(F.lit(of), before), F.lit(v)).otherwise(vowel)
    alt = lambda a, flag: F.struct(a.alias("alt"), F.lit(flag).alias("flag"))
    none = F.array().cast("array<struct<alt:string,flag:int>>")
    small = F.when(F.contains(F.lit(SMALL), ch), F.array(alt(F.translate(ch, SMALL, LARGE), REPLACE | REPLACE_SMALL))).otherwise(none)
    by_vowel = F.when(F.contains(F.lit(PROLONGED_E), before), F.array(alt(vowel, REPLACE | REPLACE_PROLONG), alt(F.lit("え"), REPLACE | REPLACE_PROLONG | E_ROW))).otherwise(F.array(alt(vowel, REPLACE | REPLACE_PROLONG)))
    return F.when(_is(cls, "CHOON") & (before != "") & vowel.isNotNull(), by_vowel).otherwise(small)


def deletion(ch: Column, before: Column, after: Column, cls: Column, cls_before: Column, cls_after: Column, gone: Column) -> Column:
    """Flag of the rule by which ch may be left out, 0 if by none; gone: `before` may too."""
    prolong = _is(cls, "CHOON") & (gone | _is(cls_before, "FAMILY_PROLONGABLE"))
    common = _is(cls_before.bitwiseAND(cls_after).bitwiseAND(cls), "FAMILY_FULL_KANA")
    other = _is(cls_after, "SPACE|IDEOGRAPHIC_PUNC|FIGURE|PERIOD|MIDDLE_DOT|ALPH|SYMBOL|BRACKET|SLASH|COLON|COMMA")
    tsu = ch.isin("っ", "ッ") & (gone | (after == "") | other | (ch == after) | common)
    small = gone & (ch == before) & ch.isin(*BEFORE_SMALL)
    for s, of in BEFORE_SMALL.items():
        small = small | ((ch == s) & F.contains(F.lit(of), before))
    return F.when((before == "") | ~_is(cls, "FAMILY_DOUBLE"), 0).when(prolong, DELETE | DELETE_PROLONG).when(tsu, DELETE | DELETE_TSU).when(small, DELETE | DELETE_SMALL).otherwise(0)


def with_char_lattice(df: DataFrame, text: str, into: str = "lattice") -> DataFrame:
    """df with array<struct<ch, alts array<struct<alt, flag>>, drop int>>: for each character
    its replacements, and the flag of its deletion. A fold from the left finds the deletions,
    since whether the character before may go matters."""
    df = df.withColumn("_c", F.filter(F.split(text, ""), lambda c: c != "")).withColumn("_k", F.transform("_c", char_class))
    ch = lambda i: F.coalesce(F.get(F.col("_c"), i), F.lit(""))
    cls = lambda i: F.coalesce(F.get(F.col("_k"), i), F.lit(0))
    every = F.when(F.size("_c") > 0, F.sequence(F.lit(0), F.size("_c") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_i", every)
    gone = lambda a, i: F.coalesce(F.get(a, i - 1) != 0, F.lit(False))
    drops = F.aggregate("_i", F.array().cast("array<int>"), lambda a, i: F.array_append(a, deletion(ch(i), ch(i - 1), ch(i + 1), cls(i), cls(i - 1), cls(i + 1), gone(a, i))))
    df = df.withColumn("_d", drops)
    each = F.transform("_i", lambda i: F.struct(ch(i).alias("ch"), replacements(ch(i), ch(i - 1), cls(i)).alias("alts"), F.get(F.col("_d"), i).alias("drop")))
    return df.withColumn(into, each).drop("_c", "_k", "_i", "_d")


def normal_form(lattice: str) -> Column:
    """The text with each character left out, or replaced by its first alternative, where it may."""
    return F.array_join(F.transform(lattice, lambda x: F.when(x["drop"] != 0, "").when(F.size(x["alts"]) > 0, F.get(x["alts"], F.lit(0))["alt"]).otherwise(x["ch"])), "")


_OTHER = "SPACE|IDEOGRAPHIC_PUNC|FIGURE|PERIOD|MIDDLE_DOT|ALPH|SYMBOL|BRACKET|SLASH|COLON|COMMA"


def _table(pairs: dict[str, str]) -> np.ndarray:
    """For each character below 2^16 the one that it stands beside in pairs, 0 for others."""
    out = np.zeros(1 << 16, np.int64)
    for a, b in pairs.items():
        out[ord(a)] = ord(b)
    return out


_VOWEL = _table({c: v for v, of in PROLONGED.items() for c in of})
_E_ROW = _table({c: "え" for c in PROLONGED_E})
_LARGE = _table(dict(zip(SMALL, LARGE)))


def alternatives(codes: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The rules of replacements() and deletion() for a whole batch of sentences: for each
    character its two replacements (character or 0, flags), and the flags of its deletion or 0.
    Sentences are separated by a 0. A character that may go only if the one before does belongs
    to a chain, which goes back to the last one that may go by itself."""
    low = np.where(codes < 1 << 16, codes, 0)
    cls = np.where(codes > 0, classes_of(codes), 0)
    shift = lambda x: np.concatenate(([0], x[:-1]))
    back = lambda x: np.concatenate((x[1:], [0]))
    has = lambda bits, name: bits & class_by_name(name) != 0
    before, after, prior, later = shift(low), back(codes), shift(cls), back(cls)
    inner = has(cls, "FAMILY_DOUBLE") & (shift(codes) > 0)
    choon = has(cls, "CHOON")
    vowel = np.where(inner & choon, _VOWEL[before], 0)
    large = np.where((vowel == 0), _LARGE[low], 0)
    first = (np.where(vowel > 0, vowel, large), np.where(vowel > 0, REPLACE | REPLACE_PROLONG, REPLACE | REPLACE_SMALL))
    second = (np.where(vowel > 0, _E_ROW[before], 0), np.full(len(codes), REPLACE | REPLACE_PROLONG | E_ROW))
    tsu = np.isin(codes, [ord("っ"), ord("ッ")])
    small, chained_small = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    for s, of in BEFORE_SMALL.items():
        small |= (codes == ord(s)) & np.isin(before, [ord(c) for c in of])
        chained_small |= (codes == ord(s)) & (before == ord(s))
    alone_tsu = (after == 0) | has(later, _OTHER) | (after == codes) | has(prior & later & cls, "FAMILY_FULL_KANA")
    alone = inner & ((choon & has(prior, "FAMILY_PROLONGABLE")) | (tsu & alone_tsu) | small)
    chained = inner & (choon | tsu | chained_small)
    place = np.arange(len(codes))
    gone = np.maximum.accumulate(np.where(alone, place, -1)) >= np.maximum.accumulate(np.where(chained, -1, place)) if len(codes) else alone
    flags = np.where(choon, DELETE | DELETE_PROLONG, np.where(tsu, DELETE | DELETE_TSU, DELETE | DELETE_SMALL))
    return [first, second], np.where(gone, flags, 0)


#: Fixed values of number words.
PREFIXES, INTERFIXES, SUFFIXES = "数何幾", ("ぶんの", "分の"), ("キロ", "メガ", "ギガ", "テラ", "ミリ")
MOST_FIGURES = 64
_F, _DIGIT = "0-9０-９", "十百千万億兆"
_D, _E = _F + "○〇零一二三四五六七八九" + _DIGIT, _F + "○〇零一二三四五六七八九" + _DIGIT + PREFIXES
_SUF = "|".join(SUFFIXES)
#: The longest number from the start of a text: digits; a prefix before a digit or a unit; between
#: digits a fraction word; a unit; a comma before just three figures; a period between digits.
NUMBER = (
    rf"^(?:[{_D}]|[{PREFIXES}](?:(?=[{_DIGIT}])|(?:{_SUF}))|(?<=[{_D}])(?:{'|'.join(INTERFIXES)})(?=[{_D}])"
    rf"|(?<=[{_E}])(?:{_SUF})|(?<!^)[,，](?=[{_F}]{{3}}(?![{_F}]))|(?<=[{_D}])[．・·](?=[{_D}])){{0,{MOST_FIGURES}}}+"
)
