"""English stems by the published Porter2 rules, applied to distinct words only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the published rules: words that keep or have their own stems, suffixes and what they become.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
_STEP2, _STEP3 = tuple(STEP2), tuple(STEP3)
_VOWELS = "aeiouy"


def _region(w: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(w)):
        if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _longest(w: str, suffixes: tuple[str, ...]) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len) if w.endswith(suffixes) else ""


def stem(word: str) -> str:
    w = word.removeprefix("'")
    if len(w) <= 2:
        return w
    if w in WHOLE:
        return WHOLE[w]
    if "y" in w:
        w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), _region(w, 0))
    r2 = _region(w, r1)
    if s := _longest(w, ("'", "'s", "'s'")):
        w = w[: -len(s)]
    # plurals
    if s := _longest(w, ("sses", "ied", "ies", "us", "ss", "s")):
        if s == "sses":
            w = w[:-2]
        elif s in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif s == "s" and any(c in _VOWELS for c in w[:-2]):
            w = w[:-1]
    if w in AFTER_PLURAL:
        return w
    # past and present participles
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # derivations
    if (s := _longest(w, _STEP2)) and len(w) - len(s) >= r1:
        before = w[len(w) - len(s) - 1 : len(w) - len(s)]
        if not (s == "ogi" and before != "l") and not (s == "li" and before not in tuple("cdeghkmnrt")):
            w = w[: -len(s)] + STEP2[s]
    if (s := _longest(w, _STEP3)) and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + STEP3[s]
    if (s := _longest(w, STEP4)) and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term of terms(term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem(t) for t in b.column(0).to_pylist()], pa.string())], names=["term", "stem"])

    return terms.select("term").where("term is not null").distinct().mapInArrow(run, "term string, stem string")
