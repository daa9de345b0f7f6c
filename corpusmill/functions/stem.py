"""The Porter2 stemmer for English, from its published description, and the full analyzer."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ACRONYMS, STOPWORDS, SYNONYMS, WORD

_VOWELS = "aeiouy"
_STOP = frozenset(STOPWORDS)
#: Words with stems of their own, and words that stay as they are after step 1a.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes of steps 2 to 4, longest first where they overlap.
STEP2 = (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins, from ``start``."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.removeprefix("'")
    # y that acts as a consonant is marked Y
    word = re.sub(r"(?:^y|(?<=[aeiouy])y)", "Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _region(word, 0)
    r2 = _region(word, r1)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b: past and continuous forms
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            if end in ("eed", "eedly"):
                if len(word) - len(end) >= r1:
                    word = word[: -len(end)] + "ee"
            elif any(c in _VOWELS for c in word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] in "bdfgmnprt":
                    word = word[:-1]
                elif r1 >= len(word) and _short_end(word):
                    word += "e"
            break
    # 1c: a final y after a consonant
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2: longer suffixes
    for end, new in STEP2:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and not (end == "ogi" and word[at - 1 : at] != "l") and not (end == "li" and word[at - 1 : at] not in tuple("cdeghkmnrt")):
                word = word[:at] + new
            break
    # 3
    for end, new in STEP3:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= (r2 if end == "ative" else r1):
                word = word[:at] + new
            break
    # 4
    for end in STEP4:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and not (end == "ion" and word[at - 1 : at] not in ("s", "t")):
                word = word[:at]
            break
    # 5: a final e or l
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_WORDS = re.compile(WORD.replace(r"\p{L}\p{N}_", r"\w"))


def _normal(word: str) -> str:
    word = SYNONYMS.get(word, word)
    return word if "-" in word or len(word) <= 2 else stem(word)


def analyze(text: str | None) -> list[str]:
    """The full analyzer (SF5): stop words go, synonyms are applied, words are stemmed; an acronym
    adds its words where they have not come up before."""
    out: list[str] = []
    for w in _WORDS.findall((text or "").lower()):
        if w in _STOP or not w.replace("-", "").isalpha():
            continue
        token = _normal(w)
        out.append(token)
        for extra in map(_normal, ACRONYMS.get(token, [])):
            if extra not in out:
                out.append(extra)
    return out


#: A hundred rows at once: an Arrow batch would hold the words of ten thousand texts as objects.
stemmed_tokens = F.udf(analyze, T.ArrayType(T.StringType()), useArrow=False)


def expand_query(query: str) -> list[str]:
    """A query's variants (SF37): itself, its tokens, itself with what acronyms stand for, its
    different tokens; repeats by white space are dropped (SO2)."""
    q = (query or "").strip()
    if not q:
        return []
    tokens = analyze(q)
    extra = [x for t in tokens for x in ACRONYMS.get(t, [])]
    variants = [q, " ".join(tokens), *([f"{q} {' '.join(extra)}"] if extra else []), " ".join(dict.fromkeys(analyze(q.lower())))]
    seen: dict[str, str] = {}
    for v in variants:
        seen.setdefault(" ".join(v.split()), v)
    return [v for k, v in seen.items() if k]
