"""Porter's stems of English words (M. F. Porter, An algorithm for suffix stripping, 1980) and folding of accents.

Stems are made once per distinct word: `stemmed` joins them to rows of words, so the Python
step sees a vocabulary and not a corpus.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffixes of steps 2, 3 and 4 of the published algorithm and what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", shape(stem))))


def double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Ends with consonant, vowel, consonant, of which the last is not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def tense(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    suffix = longest(word, ("ed", "ing"))
    if suffix is None or "v" not in shape(word[: -len(suffix)]):
        return word
    stem = word[: -len(suffix)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if double(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if measure(stem) == 1 and short_end(stem) else stem


def replaced(word: str, table: dict[str, str]) -> str:
    suffix = longest(word, table)
    if suffix and measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + table[suffix]
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer, and of others than a to z, stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = tense(plural(word))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2), STEP_3)
    suffix = longest(word, STEP_4)
    if suffix and measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[-4] in "st"):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def folded(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


@F.arrow_udf(T.StringType())
def stem_of(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else porter(folded(w)) for w in words.to_pylist()], pa.string())


def stems_of(rows: DataFrame, word: str = "term") -> DataFrame:
    """The distinct words of `rows` (__word) and the stem of each (`word`)."""
    return rows.select(F.col(word).alias("__word")).distinct().where("__word is not null").withColumn(word, stem_of("__word"))


def stemmed(rows: DataFrame, word: str = "term") -> DataFrame:
    """`rows` with the column `word` replaced by its stem, made once per distinct word; null words stay null.

    A word may stand in a third of all rows: the vocabulary is joined by Spark's choice (broadcast while it is small, and
    else with skewed keys split)."""
    known = stems_of(rows, word).withColumnRenamed(word, "__stem")
    return rows.join(known, F.col(word) == F.col("__word"), "left").withColumn(word, F.col("__stem")).drop("__word", "__stem")
