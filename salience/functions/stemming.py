"""Porter's suffix stripping (M. F. Porter, 1980) for metric tokens, as an Arrow UDF on token arrays.

With the published departures that metric libraries use: a few irregular words, four-letter words in -ies and -ied keep
their e, and a final y turns to i only after a consonant that is not the first letter.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORTEST_STEMMED = 4

# Words with a stem of their own.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning",
             "innings": "inning", "outing": "outing", "outings": "outing", "canning": "canning", "cannings": "canning", "howe": "howe",
             "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}

# Fixed values of the published algorithm: suffix and replacement, longest suffix first within each step.
STEP_2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
          ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"),
          ("eli", "e")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive",
          "ize", "al", "er", "ic", "ou"]


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel) letters; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _closed(word: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, table, least: int) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + new if _measure(base) > least else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < SHORTEST_STEMMED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # plurals
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif _double(base) and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _closed(base):
                    base += "e"
                word = base
                break
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _swap(word, STEP_2, 0)
    word = _swap(word, STEP_3, 0)
    for suffix in STEP_4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _closed(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stems_of(tokens: pa.Array) -> pa.Array:
    """Tokens, or lists of tokens of any depth, as stems; the distinct tokens of the batch are stemmed once each."""
    if pa.types.is_list(tokens.type):
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, stems_of(tokens.flatten()), mask=tokens.is_null() if tokens.null_count else None)
    coded = tokens.dictionary_encode()
    return pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pa.Array) -> pa.Array:
    return stems_of(tokens)
