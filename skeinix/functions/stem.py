"""The English (Porter2) stemmer, after its published description."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("biliti", "ble"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(w: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(w)):
        if w[i] not in _V and w[i - 1] in _V:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    w = w.lstrip("'") if w.startswith("'") else w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    if m := re.match("gener|commun|arsen", w):
        r1 = m.end()
    else:
        r1 = _region(w)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # -eed, -ed, -ing
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _V for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")
