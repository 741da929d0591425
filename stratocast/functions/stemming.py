"""Porter's stemmer as column rules, for tables of distinct words.

A word's form marks each letter as a vowel or consonant; every condition of the
algorithm is a pattern over the form of what stands before a suffix. The steps
are staged columns, so each reads the word that the one before left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffixes and what replaces them, the first that fits counts.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
LONG = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
MIDDLE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
ENDINGS = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
SHORTEST = 4  # words below this length keep their form in ROUGE


def _form(word: Column) -> Column:
    """v or c for every letter; y is a vowel after a consonant."""
    letters = F.split(word, "")

    def add(form: Column, letter: Column) -> Column:
        vowel = letter.isin(*"aeiou") | ((letter == "y") & form.endswith("c"))
        return F.concat(form, F.when(vowel, "v").otherwise("c"))

    return F.aggregate(letters, F.lit(""), add)


class _Word:
    """A word column with its form; conditions look at the part before a suffix of `cut` letters."""

    def __init__(self, word: str, form: str):
        self.word, self.form, self.size = F.col(word), F.col(form), F.length(word)

    def before(self, cut: int) -> Column:
        return F.substr(self.word, F.lit(1), self.size - cut)

    def shape(self, cut: int) -> Column:
        return F.substr(self.form, F.lit(1), self.size - cut)

    def measure(self, cut: int) -> Column:
        return F.size(F.regexp_extract_all(self.shape(cut), F.lit("v+c+"), F.lit(0)))

    def short_end(self, cut: int) -> Column:
        """Consonant, vowel, consonant other than w, x, y; or a vowel and a consonant alone."""
        last = ~F.substr(self.before(cut), self.size - cut, F.lit(1)).isin("w", "x", "y")
        return (self.shape(cut).endswith("cvc") & last) | (self.shape(cut) == "vc")


def _first(w: _Word, rules: list[tuple[str, str]], fits: Callable[[str], Column], otherwise: Column | None = None) -> Column:
    """Replace the first suffix that the word has, where the rest fits; else the word stays."""
    out = F
    for suffix, new in rules:
        done = F.when(fits(suffix), F.concat(w.before(len(suffix)), F.lit(new))).otherwise(w.word)
        out = out.when(w.word.endswith(suffix), done)
    return out.otherwise(w.word if otherwise is None else otherwise)


def _plural(w: _Word) -> Column:
    four = w.word.endswith("ies") & (w.size == 4)
    return F.when(four, w.before(1)).otherwise(_first(w, PLURALS, lambda s: F.lit(True)))


def _past(w: _Word) -> Column:
    """Words that lose ed or ing get a mark, for what follows on it."""
    vowel = {cut: w.shape(cut).contains("v") for cut in (2, 3)}
    return (
        F.when(w.word.endswith("ied"), F.concat(w.before(3), F.when(w.size == 4, "ie").otherwise("i")))
        .when(w.word.endswith("eed"), F.when(w.measure(3) > 0, w.before(1)).otherwise(w.word))
        .when(w.word.endswith("ed") & vowel[2], F.concat(w.before(2), F.lit("+")))
        .when(w.word.endswith("ing") & vowel[3], F.concat(w.before(3), F.lit("+")))
        .otherwise(w.word)
    )


def _after_past(w: _Word) -> Column:
    marked = w.word.endswith("+")
    rest = w.before(1)
    double = rest.rlike(r"(.)\1$") & w.shape(1).endswith("cc")
    return (
        F.when(~marked, w.word)
        .when(rest.endswith("at") | rest.endswith("bl") | rest.endswith("iz"), F.concat(rest, F.lit("e")))
        .when(double, F.when(rest.rlike("[lsz]$"), rest).otherwise(w.before(2)))
        .when((w.measure(1) == 1) & w.short_end(1), F.concat(rest, F.lit("e")))
        .otherwise(rest)
    )


def _final_y(w: _Word) -> Column:
    fits = w.word.endswith("y") & (w.size > 2) & w.shape(1).endswith("c")
    return F.when(fits, F.concat(w.before(1), F.lit("i"))).otherwise(w.word)


def _alli(w: _Word) -> Column:
    return F.when(w.word.endswith("alli") & (w.measure(4) > 0), w.before(2)).otherwise(w.word)


def _long(w: _Word) -> Column:
    logi = F.when(w.word.endswith("logi") & (w.measure(3) > 0), w.before(1)).otherwise(w.word)
    return _first(w, LONG, lambda s: w.measure(len(s)) > 0, logi)


def _middle(w: _Word) -> Column:
    return _first(w, MIDDLE, lambda s: w.measure(len(s)) > 0)


def _ending(w: _Word) -> Column:
    def fits(s: str) -> Column:
        long = w.measure(len(s)) > 1
        return long & w.before(3).rlike("[st]$") if s == "ion" else long

    return _first(w, [(s, "") for s in ENDINGS], fits)


def _final_e(w: _Word) -> Column:
    m = w.measure(1)
    return F.when(w.word.endswith("e") & ((m > 1) | ((m == 1) & ~w.short_end(1))), w.before(1)).otherwise(w.word)


def _final_l(w: _Word) -> Column:
    return F.when(w.word.endswith("ll") & (w.measure(1) > 1), w.before(1)).otherwise(w.word)


STEPS = (_plural, _past, _after_past, _final_y, _alli, _long, _middle, _ending, _final_e, _final_l)


def with_stem(words: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """Add the stem of a column of lower-case words; give each different word once."""
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    out = words.withColumn("_word", F.col(word))
    for step in STEPS:
        out = out.withColumn("_form", _form(F.col("_word"))).withColumn("_word", step(_Word("_word", "_form")))
    whole = F.when(F.length(word) <= 2, F.col(word)).otherwise(F.col("_word"))
    return out.withColumn(name, F.coalesce(F.try_element_at(irregular, F.col(word)), whole)).drop("_word", "_form")
