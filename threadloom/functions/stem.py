"""Search terms: case and accents folded, runs of letters and digits, English endings cut by Porter's rules."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

#: Porter's suffix rules of steps 2 and 3 (what stands for a suffix), and the suffixes that step 4 drops.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Endings of which a word has one if any rule changes it.
ENDINGS = ("s", "y", "e", "i", "ed", "ing", "ic", "ou", "nt", "ism", "ion", "er", "or", "al", "ful", "ll")

_TERM = re.compile(r"[^\W_]+")
_KINDS = {i: "v" if chr(i) in "aeiou" else "c" for i in range(128)}


@cache
def _marks() -> re.Pattern[str]:
    """Runs of marks, and of what lies beyond 16 bits: a set of both is slow."""
    return re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x10000)) if _is_mark(c)) + "]+|[\U00010000-\U0010ffff]+")


def _is_mark(c: str) -> bool:
    return unicodedata.category(c).startswith("M")


def fold(text: str) -> str:
    """Lower case, without accents: what is decomposed into a letter and marks keeps the letter."""
    text = text.lower()
    if text.isascii():
        return text
    return _marks().sub(lambda m: "".join(c for c in m[0] if c > "\uffff" and not _is_mark(c)), unicodedata.normalize("NFD", text))


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel behind a consonant."""
    if "y" not in word and word.isascii():
        return word.translate(_KINDS)
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _plural_and_past(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, ("ed", "ing"))
    if suffix and "v" in _shape(word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Porter's stem of a folded word; words of fewer than three or more than 64 bytes stay."""
    if not word.endswith(ENDINGS) or not 3 <= len(word.encode()) <= 64:
        return word
    word = _plural_and_past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        suffix = _longest(word, rules)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + rules[suffix]
    suffix = _longest(word, STEP4)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def words(text: str | None) -> list[str]:
    """A text's runs of letters and digits, folded, in order."""
    return _TERM.findall(fold(text or ""))


def terms(text: str | None) -> list[str]:
    """Stems of a text's words, in order."""
    return [stem(t) for t in words(text)]


def query_phrases(query: str) -> list[list[str]]:
    """Phrases of a search text: its ``[\\w@.-]+`` runs, each as the terms it holds."""
    found = [terms(run) for run in re.findall(r"[\w@.\-]+", query)]
    return [p for p in found if p]
