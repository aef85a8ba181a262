"""Stems of English words by the published Porter 2 rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodespar.shipping import arrow_column

#: Fixed values of the published rules: vowels, doubled letters, endings before which li goes, whole words.
_V, _DOUBLE, _LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_LATE = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_REGION = re.compile(f"[{_V}][^{_V}]")


def _regions(w: str) -> tuple[int, int]:
    """Where the parts after the first, and after the second, consonant behind a vowel begin."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if start is None:
        m = _REGION.search(w)
        start = m.end() if m else len(w)
    m = _REGION.search(w, start)
    return start, m.end() if m else len(w)


def _short(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def _longest(w: str, ends) -> str:
    return max((e for e in ends if w.endswith(e)), key=len, default="")


@lru_cache(100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w in _WORDS:
        return _WORDS[w]
    w = w.lstrip("'")
    # a y that stands for a consonant is written large
    w = re.sub(f"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _LATE:
        return w
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _V for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if w[-1:] in "yY" and len(w) > 2 and w[-2] not in _V:
        w = w[:-1] + "i"
    end = _longest(w, (*_STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        head = w[: -len(end)]
        if end in _STEP2:
            w = head + _STEP2[end]
        elif (end == "ogi" and head.endswith("l")) or (end == "li" and head[-1:] in _LI and head):
            w = head + ("og" if end == "ogi" else "")
    end = _longest(w, (*_STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + _STEP3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _longest(w, (*_STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(words: pa.Array) -> pa.Array:
    return pa.array([None if x is None else stem(x) for x in words.to_pylist()], pa.string())


def word_stem(word, lang: str = "en") -> Column:
    """The stem of an English word, in small letters."""
    if lang != "en":
        raise ValueError(f"no stemmer for {lang}")
    return arrow_column(_stems, "string")(word if isinstance(word, Column) else F.col(word) if isinstance(word, str) else F.lit(word))


FUNCTIONS: dict[str, Callable[..., Column]] = {"word_stem": word_stem}
