"""Porter stemmer as a pandas UDF (Porter, 1980)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy](?:[aeiou])*"
_M0 = re.compile(f"^(?:{_C})?{_V}{_C}")
_M1 = re.compile(f"^(?:{_C})?(?:{_V}{_C}){{2,}}")
_EQ1 = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_HAS_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_CVC = re.compile("[^aeiou][aeiouy][^aeiouwxy]$")
# The suffix pairs of steps 2 and 3 and the suffixes of step 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def stem_word(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = ""
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    elif w.endswith("ed") and _HAS_VOWEL.match(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _HAS_VOWEL.match(w[:-3]):
        cut = w[:-3]
    if cut:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeioulsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _EQ1.match(cut) and _CVC.search(cut) else cut
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, by in sorted((x.split(":") for x in table.split()), key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + by if _M0.match(w[: -len(end)]) else w
                break
    for end in sorted(_STEP4.split() + ["ion"], key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            if _M1.match(root) and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_M1.match(w[:-1]) or (_EQ1.match(w[:-1]) and not _CVC.search(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _M1.match(w) else w


def stem(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem_word(w))

    return run(text)
