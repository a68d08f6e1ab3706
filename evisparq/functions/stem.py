"""Porter's suffix stripping (the published algorithm of 1980) and the stems of tables of tokens by a dictionary."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.tables import sized

#: Suffixes of the algorithm's steps and what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_RUNS = re.compile(r"v+c+")


def _shape(word: str) -> str:
    """``v`` and ``c`` for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_RUNS.findall(_shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _plurals(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = _longest(word, ("ed", "ing"))
    if end is None or "v" not in _shape(word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _double(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short(word) else word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    word = _past(_plurals(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems():
    """A column function: the stem of a token; tokens of up to three letters stay, as in ROUGE."""
    return F.pandas_udf(lambda tokens: tokens.map(lambda w: stem(w) if len(w) > 3 else w), "string")


def stemmed(rows: DataFrame, tokens: str) -> DataFrame:
    """``rows`` with the array of tokens replaced by that of their stems. Of all tokens only the distinct ones leave the JVM, each once; the other columns must tell rows apart."""
    keys = [c for c in rows.columns if c != tokens]
    rows = scratch.written(rows, "tokens")
    each = rows.select(*keys, F.posexplode(tokens).alias("_i", "_token"))
    known = scratch.written(each.select("_token").distinct().withColumn("_stem", stems()("_token")), "stems")
    joined = each.join(sized(known), "_token").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_stem"))).alias("_all"))
    return joined.select(*keys, F.transform("_all", lambda x: x["_stem"]).alias(tokens))
