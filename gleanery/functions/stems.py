"""English word stems by the published Porter2 rules, and the stop words of English text search."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that English text search leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Fixed values of the rules: words with stems of their own, endings with what replaces them.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
DONE_EARLY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
REGION = re.compile(f"{VOWEL}{OTHER}")
SHORT_END = re.compile(f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$")
DOUBLE_END = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(f"(?:^|(?<={VOWEL}))y", "Y", word)
    early = re.match("gener|commun|arsen", w)
    first = early.end() if early else m.end() if (m := REGION.search(w)) else len(w)
    second = m.end() if (m := REGION.search(w, first)) else len(w)
    inside = lambda ending, start: len(w) - len(ending) >= start

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in DONE_EARLY:
        return w
    ending = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if inside(ending, first):
            w = w[: -len(ending)] + "ee"
    elif ending and re.search(VOWEL, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif DOUBLE_END.search(w):
            w = w[:-1]
        elif SHORT_END.search(w) and first >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not re.match(VOWEL, w[-2]):
        w = w[:-1] + "i"

    ending = longest(w, (*SECOND, "ogi", "li"))
    if ending and inside(ending, first):
        if ending in SECOND:
            w = w[: -len(ending)] + SECOND[ending]
        elif ending == "ogi" and w[-4:-3] == "l":
            w = w[:-1]
        elif ending == "li" and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    ending = longest(w, (*THIRD, "ative"))
    if ending and inside(ending, first):
        if ending in THIRD:
            w = w[: -len(ending)] + THIRD[ending]
        elif inside(ending, second):
            w = w[: -len(ending)]
    ending = longest(w, (*FOURTH, "ion"))
    if ending and inside(ending, second) and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e") and (inside("e", second) or inside("e", first) and not SHORT_END.search(w[:-1])) or w.endswith("ll") and inside("l", second):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem)


@lru_cache(1 << 16)
def known(word: str) -> str:
    """The stem, remembered by the worker."""
    return stem(word)


@F.arrow_udf(ArrayType(StringType()))
def stemmed_all(words: pa.Array) -> pa.Array:
    """The stems of arrays of words, in their places; nulls stay. The rules run once for a distinct word of a batch."""
    coded = words.flatten().dictionary_encode()
    stems = pa.array([w and known(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = np.cumsum([0, *words.value_lengths().fill_null(0).to_pylist()])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems.take(coded.indices), mask=words.is_null())


def stem_table(words: DataFrame) -> DataFrame:
    """(word, lexeme) of words (word), each once: the rules run once for a distinct word."""
    own = words.select("word").filter("word IS NOT NULL").distinct()
    return own.select("word", stemmed("word").alias("lexeme"))
