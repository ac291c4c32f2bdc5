"""English stemming by the published Porter2 (Snowball English) rules."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_BEFORE = "cdeghkmnrt"
_WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ness": "", "ful": "",
}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
          "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    special = re.match(r"gener|commun|arsen", word)
    if special:
        r1 = special.end()
    else:
        found = _REGION.search(word)
        r1 = found.end() if found else len(word)
    found = _REGION.search(word, r1)
    return r1, found.end() if found else len(word)


def stem(word: str) -> str:
    """Stem of one word."""
    word = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    if word in _WHOLE_WORDS:
        return _WHOLE_WORDS[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)

    # Step 1a: plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")):
        if re.search(r"[aeiouy].+s$", word):
            word = word[:-1]
    if word in _AFTER_1A:
        return word.lower()

    # Step 1b: past and progressive forms.
    suffix = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed")
                   if word.endswith(s)), "")
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and re.search(r"[aeiouy]", word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"

    # Step 1c: final y after a consonant that is not the first letter.
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    # Step 2 and 3: derivational endings in R1; the longest ending decides.
    ending = next((s for s in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True)
                   if word.endswith(s)), None)
    if ending and len(word) - len(ending) >= r1:
        base = word[: -len(ending)]
        if ending == "ogi":
            word = base + "og" if base.endswith("l") else word
        elif ending == "li":
            word = base if base and base[-1] in _LI_BEFORE else word
        else:
            word = base + _STEP2[ending]
    ending = next((s for s in sorted([*_STEP3, "ative"], key=len, reverse=True)
                   if word.endswith(s)), None)
    if ending and len(word) - len(ending) >= r1:
        base = word[: -len(ending)]
        if ending == "ative":
            word = base if len(base) >= r2 else word
        else:
            word = base + _STEP3[ending]

    # Step 4: endings in R2.
    ending = next((s for s in sorted([*_STEP4, "ion"], key=len, reverse=True)
                   if word.endswith(s)), None)
    if ending and len(word) - len(ending) >= r2:
        base = word[: -len(ending)]
        if ending != "ion" or base.endswith(("s", "t")):
            word = base

    # Step 5: final e and double l.
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT_END.search(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


# Workers get the functions of this module with the task, whatever their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.StringType())
def stem_terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stem a column of tokens; each distinct token of a batch is stemmed once."""
    for tokens in batches:
        codes, words = pd.factorize(tokens)
        stems = pd.Series([stem(w) for w in words] + [None], dtype="object")
        yield stems.take(codes).reset_index(drop=True)


# Distinct words whose stems a task remembers from one batch to the next.
REMEMBERED = 200_000


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem the words of texts, each a list; each distinct word of a batch is stemmed once, and
    most words of the later batches not again."""
    known: dict[str, str] = {}
    for lists in batches:
        words = lists.flatten().dictionary_encode()
        if len(known) > REMEMBERED:
            known.clear()
        stems = []
        for word in words.dictionary.to_pylist():
            if word not in known:
                known[word] = stem(word)
            stems.append(known[word])
        found = pa.array(stems, pa.string()).take(words.indices)
        counts = pc.fill_null(pc.list_value_length(lists), 0)
        ends = pc.cumulative_sum(pc.cast(counts, pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        yield pa.ListArray.from_arrays(offsets, found, mask=lists.is_null())
