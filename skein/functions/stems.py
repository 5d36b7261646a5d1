"""Terms of full text: words without case and accents, stemmed by Porter's rules."""

import re
import unicodedata

# The suffixes of the English stemmer's steps and what replaces them (Porter 1980 with the author's later revisions).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
SHORTEST, LONGEST = 3, 63

WORD = re.compile(r"[^\W_]+")


def form(word: str) -> str:
    """A letter for each of a word's: ``v`` for vowels and for a y after a consonant, else ``c``."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return form(stem).count("vc")


def _twin(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and form(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    return form(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of fewer than three letters or over 63 bytes stay."""
    if len(word) < SHORTEST or len(word.encode()) > LONGEST:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    ending = _longest(word, ("eed", "ed", "ing"))
    if ending == "eed":
        word = word[:-1] if measure(word[:-3]) else word
    elif ending and "v" in form(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _twin(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in form(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        ending = _longest(word, rules)
        if ending and measure(word[: -len(ending)]):
            word = word[: -len(ending)] + rules[ending]
    ending = _longest(word, STEP_4)
    if ending and measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def folded(text: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def terms(text: str | None) -> list[str]:
    """The stems of a text's words, in order: what a query must be put through too."""
    return [stem(w) for w in WORD.findall(folded(text or ""))]
