"""The English (Porter2) stemming algorithm, as published with the Snowball language."""

from __future__ import annotations

import functools
import re

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"

# Fixed values of the published algorithm: whole words with stems of their own, before and after step 1a.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less", "ogi": "og", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_PREFIX = re.compile(r"^(gener|commun|arsen)")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


@functools.lru_cache(maxsize=1 << 15)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.removeprefix("'")
    # y at the start or after a vowel is a consonant, written Y
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    p = _PREFIX.match(w)
    r1 = p.end() if p else _region(w, 0)
    r2 = _region(w, r1)

    for s in ("'s'", "'s", "'"):  # step 0
        if w.endswith(s):
            w = w[: -len(s)]
            break

    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))  # step 1a
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w

    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))  # step 1b
    if s.startswith("eed"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and _has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:  # step 1c
        w = w[:-1] + "i"

    s = _longest(w, _STEP2)
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if not (s == "ogi" and not before.endswith("l")) and not (s == "li" and before[-1:] not in tuple(_LI)):
            w = before + _STEP2[s]

    s = _longest(w, _STEP3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _STEP3[s]

    s = _longest(w, _STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]

    if w.endswith("e"):  # step 5
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
