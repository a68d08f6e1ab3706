"""Column builders for text: tokenizers, normalizers, identifiers, hashes.

All of them run inside the JVM. Offsets count code points.
"""

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources import jvm

#: Token patterns.
BM25_TOKEN = r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*"
WORD_TOKEN = r"[\p{L}\p{N}_]+(?:[-_/][\p{L}\p{N}_]+)*"
PLAIN_TOKEN = r"[A-Za-z0-9]+"
BUDGET_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SENTENCE_GAP = r"(?<=[.!?])(\s+)(?=[A-Z0-9])"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _all(x: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(pattern), 0)


def _plain_lower(x: Column | str) -> Column:
    """Lower case of the whole text at once. The two characters beyond ASCII whose lower case has ASCII letters (Kelvin sign, dotted capital I) count as white space, as no token has them."""
    return F.lower(F.translate(_col(x), "\u212a\u0130", "  "))


def bm25_tokens(x: Column | str) -> Column:
    """Lower-case retrieval tokens; null text has none."""
    return _all(_plain_lower(x), BM25_TOKEN)


def word_tokens(x: Column | str) -> Column:
    """Tokens of letters, digits and underscores in any script."""
    return _all(x, WORD_TOKEN)


def plain_tokens(x: Column | str) -> Column:
    return _all(_plain_lower(x), PLAIN_TOKEN)


def budget_tokens(x: Column | str) -> Column:
    """Number of tokens that count against a context budget."""
    return F.size(_all(x, BUDGET_TOKEN))


def normalize(x: Column | str) -> Column:
    """Lower-case words joined by single spaces, for grouping equal questions and answers."""
    return F.array_join(F.transform(word_tokens(x), F.lower), " ")


def clean_query(x: Column | str) -> Column:
    """White space collapsed; null for queries without any word."""
    return F.nullif(F.trim(F.regexp_replace(_col(x), r"\s+", " ")), F.lit(""))


def last_segment(x: Column | str) -> Column:
    """Identifier at the end of a path or URL."""
    return F.element_at(F.split(F.regexp_replace(_col(x), "/+$", ""), "/"), -1)


def trailing_number(x: Column | str) -> Column:
    """Digits before an optional final slash; empty if there are none."""
    return F.regexp_extract(_col(x), r"(\d+)/?$", 1)


def cited_ids(x: Column | str) -> Column:
    """Numbers of all citation labels in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"\[PMID:(\d+)\]"), 1))


def stable_order(x: Column | str, seed: int) -> Column:
    """A sort key that shuffles identifiers the same way everywhere."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _col(x).cast("string")), 256)


def year_of(x: Column | str) -> Column:
    return F.when(F.substring(_col(x), 1, 4).rlike(r"^\d+$"), F.substring(_col(x), 1, 4).cast("int"))


def content_hash(*columns: Column | str) -> Column:
    """SHA-256 over values in a fixed order; null and the empty string differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), _col(c).cast("string")), F.lit("!")) for c in columns]), 256)


def casefold_normalize(spark: SparkSession) -> Callable[[Column | str], Column]:
    """A column function: the exact normalizer (NFKC, full case folding, words joined by single spaces), in the JVM. Null becomes empty."""
    jvm.register(spark, "evisparq_exact_normalizer", jvm.JAVA / "ExactNormalizer.java", StringType())
    return lambda x: F.call_function("evisparq_exact_normalizer", _col(x))
