"""English text as a search index reads it: tokens without stop words, cut to their stems (the published Porter2 rules)."""

from __future__ import annotations

import re
from functools import lru_cache

# fixed values: the usual English stop words
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
    should now""".split()
)
# fixed values: words whose stem no rule gives, words that are their own stem, and the endings of each step
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
KEPT_LATER = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = "[aeiouy]"
_REGION = re.compile(rf"{_VOWEL}[^aeiouy]")
_SHORT = re.compile(rf"(?:[^aeiouy]{_VOWEL}[^aeiouywxY]|^{_VOWEL}[^aeiouy])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts begin that follow the first, and the second, vowel with a consonant after it."""
    head = re.match("gener|commun|arsen", word)
    first = head.end() if head else (m.end() if (m := _REGION.search(word)) else len(word))
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _longest_first(*endings: str) -> tuple[str, ...]:
    return tuple(sorted(endings, key=len, reverse=True))


PAST_ENDINGS = _longest_first("eed", "eedly", "ed", "edly", "ing", "ingly")
ENDINGS2, ENDINGS3, ENDINGS4 = _longest_first(*STEP2, "ogi", "li"), _longest_first(*STEP3, "ative"), _longest_first(*STEP4, "ion")


def _ending(word: str, endings: tuple[str, ...]) -> str | None:
    """The longest of the endings, given longest first, that a word has."""
    return next(e for e in endings if word.endswith(e)) if word.endswith(endings) else None


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    end = _ending(word, PAST_ENDINGS)
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
    if end and re.search(_VOWEL, word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            return word + "e"
        if word.endswith(DOUBLES):
            return word[:-1]
        if first >= len(word) and _SHORT.search(word):
            return word + "e"
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or word in KEPT:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # a y that is a consonant is written large
    word = re.sub("(?<=[aeiouy])y", "Y", re.sub("^y", "Y", word))
    first, second = _regions(word)
    word = _plural(word)
    if word in KEPT_LATER:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    end = _ending(word, ENDINGS2)
    if end and len(word) - len(end) >= first:
        if end == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif end == "li":
            word = word[:-2] if word[-3:-2] and word[-3] in "cdeghkmnrt" else word
        else:
            word = word[: -len(end)] + STEP2[end]
    end = _ending(word, ENDINGS3)
    if end and len(word) - len(end) >= first:
        if end != "ative":
            word = word[: -len(end)] + STEP3[end]
        elif len(word) - len(end) >= second:
            word = word[: -len(end)]
    end = _ending(word, ENDINGS4)
    if end and len(word) - len(end) >= second and (end != "ion" or word.endswith(("sion", "tion"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or (at >= first and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


def query_terms(query: str) -> list[str]:
    """Distinct stems of a query's words that are no stop words: none of them may be missing from a match."""
    words = [w for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP_WORDS]
    return list(dict.fromkeys(map(stem, words)))
