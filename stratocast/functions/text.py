"""Token, overlap and style columns for short and medium text.

Everything here is a Column -> Column expression on the JVM, but for the LCS,
which is an Arrow-batched function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words left out of metric tokens.
STOPWORDS = ["a", "an", "and", "are", "by", "for", "in", "is", "of", "the", "to", "with"]

# What str.split() takes for white space, as the inside of a character class.
SPACE = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same class for Java, with one test for all but the Latin characters.
_SPACE = (
    r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
SPACE_CLASS = _SPACE
# All of them but the plain blank: replacing blanks by blanks would rebuild every text.
_ODD_SPACE = _SPACE.replace("[ ", "[", 1)
# One lower-case metric token that is no stopword.
_TOKEN = r"(?<![a-z0-9])(?!(?:" + "|".join(STOPWORDS) + r")(?![a-z0-9]))[a-z0-9]+"


def bind(value: Column, body) -> Column:
    """Evaluate `value` once for an expression that reads it many times."""
    return F.transform(F.array(value), body)[0]


def even_space(text: Column) -> Column:
    """Every white space character as a plain blank."""
    return F.regexp_replace(text, _ODD_SPACE, " ")


def _pieces(text: Column, separator: str) -> Column:
    # Non-empty parts; separators are one plain character, which splits without a regex.
    return F.array_remove(F.split(text, separator if separator == " " else "\\" + separator), "")


def words(text: Column) -> Column:
    """White-space words, [] for empty text."""
    return _pieces(even_space(text), " ")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def metric_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric tokens without stopwords; [] for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def rouge_tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric tokens, stopwords included; [] for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams in order; [] when there are fewer than n tokens."""
    if n == 1:
        return tokens
    if n == 2:
        rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - F.lit(1), F.lit(0)))
        firsts = F.slice(tokens, F.lit(1), F.size(rest))
        return F.zip_with(firsts, rest, lambda x, y: F.concat(x, F.lit(" "), y))
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0)))
    return F.transform(
        starts,
        lambda x, i: F.concat_ws(" ", x, *[F.get(tokens, i + F.lit(k)) for k in range(1, n)]),
    )


def occurrences(items: Column) -> Column:
    """Number equal items 0, 1, ... so that a multiset becomes a set."""

    def number(ordered: Column) -> Column:
        return F.transform(
            ordered, lambda x, i: F.concat(x, F.lit("\x01"), (i - F.array_position(ordered, x)).cast("string"))
        )

    return bind(F.sort_array(items), number)


def overlap_count(items_a: Column, items_b: Column) -> Column:
    """Size of the multiset intersection of two arrays.

    When one side repeats nothing, the set intersection has that size already.
    Pass columns, not expressions: both are read several times.
    """

    def plain(items: Column) -> Column:
        return F.size(F.array_distinct(items)) == F.size(items)

    return F.when(plain(items_a) | plain(items_b), F.size(F.array_intersect(items_a, items_b))).otherwise(
        F.size(F.array_intersect(occurrences(items_a), occurrences(items_b)))
    )


def runs(items: Column) -> Column:
    """The different items in order, each with its count: an array of (item, n)."""

    def told(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(ordered, lambda x, i: F.when(~x.eqNullSafe(F.get(ordered, i - 1)), i)))

        def numbered(at: Column) -> Column:
            ends = F.slice(at, F.lit(2), F.size(at))
            return F.zip_with(
                at, ends, lambda i, j: F.struct(F.get(ordered, i).alias("item"), (F.coalesce(j, F.size(ordered)) - i).alias("n"))
            )

        return bind(starts, numbered)

    return bind(F.sort_array(items), told)


def runs_overlap(runs_a: Column, runs_b: Column) -> Column:
    """Size of the multiset intersection of two arrays, from their runs: linear but for a sort.

    An item of both sides stands twice in the runs together, the smaller count first.
    """
    start = F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).alias("n"), F.lit(0).alias("hits"))

    def step(seen: Column, x: Column) -> Column:
        hits = seen["hits"] + F.when(seen["item"] == x["item"], seen["n"]).otherwise(0)
        return F.struct(x["item"].alias("item"), x["n"].alias("n"), hits.alias("hits"))

    return F.aggregate(F.sort_array(F.concat(runs_a, runs_b)), start, step, lambda seen: seen["hits"])


def f1_from_sizes(overlap: Column, size_a: Column, size_b: Column) -> Column:
    """2PR / (P + R) of an overlap count, which is 2 * overlap / (a + b)."""
    return F.lit(2.0) * overlap / F.greatest(size_a + size_b, F.lit(1)).cast("double")


def overlap_f1(items_a: Column, items_b: Column) -> Column:
    """Multiset overlap F1 of two token arrays."""
    return f1_from_sizes(overlap_count(items_a, items_b), F.size(items_a), F.size(items_b))


def bleu_overlap(generated_tokens: Column, reference_tokens: Column) -> Column:
    return overlap_f1(generated_tokens, reference_tokens)


def bleu4(generated_tokens: Column, reference_tokens: Column) -> Column:
    """Sentence BLEU-4 with one reference.

    Clipped n-gram precisions for n = 1..4, geometric mean, brevity penalty. A
    zero numerator above unigrams counts as 0.1 and a denominator is at least
    1; with no unigram in common the score is 0.
    """
    def hits(n: int) -> Column:
        if n == 1:
            return overlap_count(generated_tokens, reference_tokens)
        return bind(ngrams(generated_tokens, n), lambda a: bind(ngrams(reference_tokens, n), lambda b: overlap_count(a, b)))

    return bleu4_from_counts([hits(n) for n in (1, 2, 3, 4)], F.size(generated_tokens), F.size(reference_tokens))


def bleu4_from_counts(hits: list[Column], size_g: Column, size_r: Column) -> Column:
    """BLEU-4 from the clipped counts of 1- to 4-grams and the two lengths."""

    def precision_log(n: int) -> Column:
        grams = F.greatest(size_g - F.lit(n - 1), F.lit(1)).cast("double")
        return F.log(F.greatest(hits[n - 1].cast("double"), F.lit(0.1)) / grams)

    mean_log = sum((precision_log(n) for n in (2, 3, 4)), precision_log(1)) * F.lit(0.25)
    penalty = F.when(size_g > size_r, F.lit(0.0)).otherwise(F.lit(1.0) - size_r / F.greatest(size_g, F.lit(1)))
    return F.when(hits[0] > 0, F.exp(mean_log + penalty)).otherwise(F.lit(0.0))


def rouge_n(generated_tokens: Column, reference_tokens: Column, n: int) -> Column:
    return overlap_f1(ngrams(generated_tokens, n), ngrams(reference_tokens, n))


def rouge_fallback(generated_tokens: Column, reference_tokens: Column) -> Column:
    """Struct of rouge_1, rouge_2 and rouge_l, where rouge_l is rouge_1."""
    one = rouge_n(generated_tokens, reference_tokens, 1)
    return F.struct(
        one.alias("rouge_1"),
        rouge_n(generated_tokens, reference_tokens, 2).alias("rouge_2"),
        one.alias("rouge_l"),
    )


def _lcs_length(a: list[str], b: list[str]) -> int:
    # Bit-parallel LCS: one machine-word sweep per token of b, any length.
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for token in b:
        hits = state & where.get(token, 0)
        state = ((state + hits) | (state - hits)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l_lcs(generated_tokens: pd.Series, reference_tokens: pd.Series) -> pd.Series:
    """F-measure of the true longest common subsequence of two token arrays."""
    scores = []
    for g, r in zip(generated_tokens, reference_tokens):
        lcs = _lcs_length(list(g), list(r)) if len(g) and len(r) else 0
        scores.append(2.0 * lcs / (len(g) + len(r)) if lcs else 0.0)
    return pd.Series(scores, dtype="float64")


def length_similarity(generated: Column, reference: Column) -> Column:
    return length_ratio(word_count(generated), word_count(reference))


def length_ratio(g: Column, r: Column) -> Column:
    return F.lit(1.0) - F.abs(g - r) / F.greatest(g, r, F.lit(1)).cast("double")


def vocabulary_diversity(generated: Column) -> Column:
    return distinct_share(words(F.lower(generated)))


def distinct_share(lowered: Column) -> Column:
    return F.size(F.array_distinct(lowered)) / F.greatest(F.size(lowered), F.lit(1)).cast("double")


def readability(generated: Column) -> Column:
    """Closeness of the mean words per '.'-separated piece to 15.

    Blank pieces do not count; decimal points split as well; no piece gives 0.
    """
    flat = even_space(generated)
    pieces = F.size(_pieces(F.replace(flat, F.lit(" "), F.lit("")), "."))
    spoken = F.size(_pieces(F.replace(flat, F.lit("."), F.lit(" ")), " "))
    mean = spoken / F.greatest(pieces, F.lit(1)).cast("double")
    # Without a piece the mean is 0, which scores 0.
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(mean - F.lit(15.0)) / F.lit(15.0))
