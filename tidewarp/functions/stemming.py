"""The English (Porter2) stemmer, written from its published description, and lemmatizers before it."""
import re
from collections.abc import Callable, Collection, Mapping

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
# Fixed values of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 start: after the first consonant that follows a vowel, and the same again."""

    def after(start: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(w, start)
        return m.end() if m else len(w)

    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if head is None else head
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    return bool(re.search(rf"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", w) or re.fullmatch(rf"[{VOWELS}][^{VOWELS}]", w))


def _ending(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def _step1(w: str, r1: int) -> str:
    end = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif end == "s" and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in INVARIANT:
        return w
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(f"[{VOWELS}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    return w


def _later_steps(w: str, r1: int, r2: int) -> str:
    end = _ending(w, (*STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if end == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        elif end == "li":
            w = stem if stem and stem[-1] in LI_ENDINGS else w
        else:
            w = stem + STEP2[end]
    end = _ending(w, (*STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + STEP3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _ending(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and at >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    word = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub(f"(?:^y|(?<=[{VOWELS}])y)", "Y", word)
    r1, r2 = _regions(w)
    end = _ending(w, ("'", "'s", "'s'"))
    w = w[: -len(end)] if end else w
    w = _step1(w, r1)
    if w not in INVARIANT:
        w = _later_steps(w, r1, r2)
    return w.replace("Y", "y")


def same(word: str) -> str:
    return word


#: Endings of verb forms, and what may stand in their place in the base form.
VERB_ENDINGS = (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))


def verb_lemmatizer(lemmas: Collection[str], exceptions: Mapping[str, str] | None = None) -> Callable[[str], str]:
    """Base forms of verbs, for a set of known ones and irregular forms: an irregular form's base, else the
    shortest known word that the endings make of it, else the word itself. A word that is known stays."""
    irregular = dict(exceptions or {})

    def run(word: str) -> str:
        if word in irregular:
            return irregular[word]
        made = {word} | {word[: -len(end)] + base for end, base in VERB_ENDINGS if word.endswith(end)}
        return min((w for w in made if w in lemmas), key=lambda w: (len(w), w), default=word)

    return run


def stem_phrase(phrase: str, lemmatize=same) -> str:
    """Each word of a phrase, parted by single spaces, lemmatized and stemmed."""
    return " ".join(stem(lemmatize(w)) for w in phrase.split(" "))
