"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes bad (-1), good (1) or abstains (0) on a document. Expectation-maximisation over the
counts of vote patterns (at most 3 to the number of rules) estimates how often each rule gives each vote
to good and to bad documents; a document is kept if its posterior probability of being good is at least
one half. A bad vote that the other rules don't bear out is outvoted, and several that go together reject.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Steps of expectation-maximisation at most, and the change of a posterior below which it ends.
STEPS, SETTLED = 200, 1e-6
#: The weak prior, alike for all rules and both classes: so many documents have been seen on which the rule was right, abstained, was wrong.
PRIOR = (1.0, 0.5, 0.25)
#: Runs of signs that aren't punctuation of prose.
RUNS = "[!#$%&*+<=>?@^|~]{2,}"
#: Words without a letter, and ends of sentences, in a text whose white space is single spaces.
LETTERLESS, ENDS = r"(?<![^ ])[^ \p{L}]+(?![^ ])", r"[.!?](?![^ ])"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that it for was on are as with be by this have from "
    "der die das und ist nicht ein eine mit von zu den im für auf "
    "le la les de des et un une est en que pour dans du "
    "el los las y una por con para se"
).split()
RULES = ("length", "word_length", "symbols", "symbol_runs", "letterless", "function_words", "sentences", "repeat_lines", "repeat_words", "capitals", "digits")


def _counted(docs: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """The ``carried`` columns of ``docs`` as struct ``row``, with the base counts of the text.

    Arrays stay inside higher-order functions, which are linear in the text (but for the sort of positions in
    texts that repeat a 3-word window).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.trim(F.translate(text, SPACES[:-1], " " * (len(SPACES) - 1)))
    words = F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        words.alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, SPACES[:-1], " " * (len(SPACES) - 1))) != "").alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, ASCII_UPPER, ""))).cast("long").alias("n_capitals"),
        (F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("long").alias("n_digits"),
        F.regexp_count(text, F.lit(RUNS)).alias("n_runs"),
        F.regexp_count(spaced, F.lit(LETTERLESS)).alias("n_letterless"),
        F.regexp_count(spaced, F.lit(ENDS)).alias("n_ends"),
    )
    function_words = sorted({*FUNCTION_WORDS, *(w.capitalize() for w in FUNCTION_WORDS)})
    out = out.withColumn("n_function", F.size(F.filter("words", lambda w: w.isin(function_words))))
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    pairs = F.zip_with("hashes", F.slice("hashes", 2, F.size("hashes")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    three = F.zip_with(pairs, F.slice("hashes", 3, F.size("hashes")), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab["a"], ab["b"], c)))
    # zip_with pads the shorter side with nulls: the last two windows are not whole
    out = out.withColumn("windows", F.filter(three, lambda h: h.isNotNull()))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    out = out.withColumn("placed", F.when(repeats, placed).otherwise(none)).drop("words", "lines", "hashes", "windows")
    # a window that equals its neighbour in the sorted order is found twice or more; both are marked
    both = F.zip_with("placed", F.slice("placed", 2, F.size("placed")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("marked", F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))).drop("placed")
    covered = F.array_distinct(F.flatten(F.transform("marked", lambda i: F.array(i, i + 1, i + 2))))
    return out.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("marked")


def votes() -> list[Column]:
    """One vote a rule, named after it."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def rule(name: str, good: Column, bad: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint").alias(name)

    mean, ends = chars / n, F.col("n_ends")
    return [
        rule("length", n >= 100, n < 75),
        rule("word_length", mean.between(3, 10), (mean < 2) | (mean > 15)),
        rule("symbols", F.col("n_symbols") < 0.02 * n, F.col("n_symbols") > 0.1 * n),
        rule("symbol_runs", F.col("n_runs") < 0.01 * n, F.col("n_runs") > 0.05 * n),
        rule("letterless", F.col("n_letterless") < 0.1 * n, F.col("n_letterless") > 0.2 * n),
        rule("function_words", F.col("n_function") >= 0.1 * n, F.col("n_function") < 0.05 * n),
        rule("sentences", n.between(4 * ends, 40 * ends), (n > 100 * ends) | (n < 2 * ends)),
        rule("repeat_lines", F.col("n_dup_lines") < 0.1 * F.col("n_lines"), F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        rule("repeat_words", F.col("n_repeat_words") < 0.2 * n, F.col("n_repeat_words") > 0.4 * n),
        rule("capitals", F.col("n_capitals") < 0.2 * chars, F.col("n_capitals") > 0.4 * chars),
        rule("digits", F.col("n_digits") < 0.1 * chars, F.col("n_digits") > 0.25 * chars),
    ]


def fit(patterns: dict[tuple[int, ...], int], rules: int, steps: int = STEPS) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good before any vote, and for each rule the log-likelihood ratio of good that each vote adds.

    ``patterns`` counts documents by their votes. A document starts as bad with the share of bad votes among those cast on it
    (one half without any). Nothing else holds the estimates but the prior.
    """
    right, none, wrong = PRIOR
    keys = list(patterns)
    n = np.array([patterns[p] for p in keys], float)
    votes = np.array(keys, int).reshape(len(keys), rules)
    cast = (votes != 0).sum(axis=1)
    bad = np.where(cast > 0, (votes < 0).sum(axis=1) / np.maximum(cast, 1), 0.5)
    is_vote = [votes == v for v in (-1, 0, 1)]
    # documents by vote and rule; the prior has the bad class first
    seen = lambda w, first: np.stack([w @ m for m in is_vote]) + np.array(first)[:, None]
    prior, ratios = 0.0, np.zeros((3, rules))
    for _ in range(steps):
        share = ((n * bad).sum() + 1) / (n.sum() + 2)
        prior = math.log((1 - share) / share)
        of_bad, of_good = seen(n * bad, (right, none, wrong)), seen(n * (1 - bad), (wrong, none, right))
        ratios = np.log(of_good / of_good.sum(axis=0)) - np.log(of_bad / of_bad.sum(axis=0))
        odds = prior + sum(m @ r for m, r in zip(is_vote, ratios, strict=True))
        before, bad = bad, 1 / (1 + np.exp(np.clip(odds, -500, 500)))
        if not len(bad) or np.abs(bad - before).max() < SETTLED:
            break
    return prior, [{v: float(ratios[i, j]) for i, v in enumerate((-1, 0, 1))} for j in range(rules)]


def scored(docs: DataFrame, text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``, or those named), the base counts, ``base_failed``, ``posterior`` and ``kept``, for every row.

    Null counts as empty text, which has no words and fails the base rules. The result of a row depends on its text and
    the corpus's vote patterns alone, so that ids may be null or repeated and rows tied. An empty table gives an
    empty result. Extra columns, whatever their names, stay inside ``row``.
    """
    counted = _counted(docs, text_col, docs.columns if carried is None else carried).select("*", *votes())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = scratch.written(counted.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *RULES), "votes")
    patterns = {tuple(r[:-1]): r[-1] for r in table.groupBy(*RULES).count().collect()}
    prior, ratios = fit(patterns, len(RULES))
    odds = F.lit(prior)
    for name, ratio in zip(RULES, ratios, strict=True):
        odds = odds + F.when(F.col(name) == -1, ratio[-1]).when(F.col(name) == 1, ratio[1]).otherwise(ratio[0])
    posterior = 1 / (1 + F.exp(-odds))
    return table.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of every row; see ``scored``."""
    got = scored(docs, text_col, [id_col])
    return got.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
