"""Grouping spelling variants with a bit-sliced position index.

Words of a corpus are counted, and each word is compared with the vocabulary
for words that differ by one inserted, deleted or replaced code point. The index
of words of one length holds, for every position and letter, a bitset over these
words. A query word walks through its letters once and keeps two bitsets: the
words that agree so far, and those with one error so far. A replacement reads
the bitset of its own position; after a deletion the letters are looked up one
position to the left. 64 words are compared by one operation, and queries of one
length are walked together.

Two words of five or more code points with one error share their first two code
points or their last two, so the vocabulary is dealt by both. A group is cut
into pieces of about PIECE words and every two pieces meet in one task, which
returns a count and the best neighbour for each word: no pair is ever a row.

A word's form is its near word with the most occurrences (ties: the smallest in
code-point order), if these are `ratio` times its own or more. Forms are
followed by doubling pointers, one join for each doubling of the chain.

Edge cases: a null or empty text has no words; rows without a key take part with
an empty one; repeated rows count again; an empty table gives an empty result;
other columns of the input are not looked at. A text's runs are held as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.storage import stored

RUN = "[A-Za-zÀ-ÿ]+"
CUT_EVERY = 97  # one occurrence in so many loses a code point, by hash
ENDS = 2  # code points that a group shares; words of 2 * ENDS + 1 or more are found whole
PIECE = 1 << 14  # words of a group that one task holds of each side
QUERIES = 1 << 11  # queries walked at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`word` for every maximal run of letters, A-Z lower-cased; one in CUT_EVERY, by hash, without one code point."""
    found = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), 0)).alias("run"),
    ).withColumn("run", F.translate("run", _UPPER, _LOWER))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return found.withColumn("h", h).select(F.when(F.col("h") % CUT_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """`word`, `n` for words of `shortest` code points or more that occur `least` times or more."""
    counted = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


# The index, inside a task ---------------------------------------------------------


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), -1)


def _slices(codes: np.ndarray, at: int, asked: np.ndarray) -> np.ndarray:
    """For each asked letter the bitset of the words that have it at position `at`, as 64-bit words."""
    letters, which = np.unique(asked, return_inverse=True)
    bits = np.packbits(codes[:, at][None, :] == letters[:, None], axis=1, bitorder="little")
    wide = np.zeros((len(letters), -(-len(codes) // 64) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view(np.uint64)[which]


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit of every bit that is set."""
    row, block = np.nonzero(sets)
    bits = np.unpackbits(sets[row, block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    one, bit = np.nonzero(bits)
    return row[one], block[one] * 64 + bit


def near(queries: list[str], index: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all (query, indexed word) with one code point replaced, or one of the query's deleted.

    All queries have one length, all indexed words have one length, the same or one less.
    """
    asked, codes = _codes(queries), _codes(index)
    length, held = asked.shape[1], codes.shape[1]
    if held not in (length, length - 1):
        raise ValueError("lengths must be equal, or the index shorter by one")
    whole = np.packbits(np.ones(len(index), bool), bitorder="little")
    valid = np.zeros(-(-len(index) // 64) * 8, np.uint8)
    valid[: len(whole)] = whole
    none_yet = np.tile(valid.view(np.uint64), (len(queries), 1))  # no error so far
    one = np.zeros_like(none_yet)
    for i in range(length):
        if held == length:
            here = _slices(codes, i, asked[:, i])
            one = (one & here) | (none_yet & ~here)
            none_yet &= here
        else:
            shifted = _slices(codes, i - 1, asked[:, i]) if i else np.zeros_like(one)
            one = (one & shifted) | none_yet
            if i < held:
                none_yet &= _slices(codes, i, asked[:, i])
            else:
                none_yet[:] = 0
    return _members(one)


def _by_length(words: list[str], at: np.ndarray) -> dict[int, np.ndarray]:
    sizes = np.fromiter((len(words[i]) for i in at), np.int64, len(at))
    return {int(s): at[sizes == s] for s in np.unique(sizes)}


def _pairs(words: list[str], one: np.ndarray, two: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs between the words at `one` and those at `two` (`alone`: they are the same)."""
    first, second = _by_length(words, one), _by_length(words, two)
    for asked, indexed, same in ((first, second, True), (second, first, False))[: 1 if alone else 2]:
        for size, queries in asked.items():
            for held in (size, size - 1) if same else (size - 1,):
                if held not in indexed:
                    continue
                other = indexed[held]
                for i in range(0, len(queries), QUERIES):
                    block = queries[i : i + QUERIES]
                    q, w = near([words[k] for k in block], [words[k] for k in other])
                    yield block[q], other[w]
                    if held < size or not alone:  # else each pair is met from both sides
                        yield other[w], block[q]


def _meet(group: pa.Table) -> pa.Table:
    """For each word its number of near words in the two pieces that meet here, and the best of them."""
    tail, sides = group.column("tail")[0].as_py(), group.column("sides")[0].as_py()
    words, n, piece = group.column("word").to_pylist(), group.column("n").to_numpy(), group.column("piece").to_numpy()
    order = sorted(range(len(words)), key=words.__getitem__)
    words, n, piece = [words[i] for i in order], n[order], piece[order]
    one, two = np.flatnonzero(piece == sides >> 20), np.flatnonzero(piece == sides % (1 << 20))
    count = np.zeros(len(words), np.int64)
    top_n, top = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    heads = np.array([w[:ENDS] for w in words])
    for a, b in _pairs(words, one, two, sides >> 20 == sides % (1 << 20)):
        if tail:  # those that share their first letters, too, are found by these
            apart = heads[a] != heads[b]
            a, b = a[apart], b[apart]
        count += np.bincount(a, minlength=len(words))
        by = np.lexsort((b, -n[b], a))  # words stand in code-point order
        a, b = a[by], b[by]
        lead = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else []
        a, b = a[lead], b[lead]
        better = (n[b] > top_n[a]) | ((n[b] == top_n[a]) & (b < top[a]))
        top_n[a[better]], top[a[better]] = n[b[better]], b[better]
    got = np.flatnonzero(count)
    names = pa.array(words, pa.string())
    return pa.table(
        {"word": names.take(pa.array(got)), "n_near": count[got], "best_n": top_n[got], "best": names.take(pa.array(top[got]))}
    )


# Tables ---------------------------------------------------------------------------


def near_words(vocabulary: DataFrame) -> DataFrame:
    """`word`, `n_near` and the best near word, `best` with `best_n`, of all words that have one."""
    size = F.char_length("word")
    ends = F.array(
        F.struct(F.lit(False).alias("tail"), F.substr("word", F.lit(1), F.lit(ENDS)).alias("part")),
        F.struct(F.lit(True).alias("tail"), F.substr("word", size - ENDS + 1, F.lit(ENDS)).alias("part")),
    )
    dealt = vocabulary.withColumn("end", F.explode(ends)).select("word", "n", "end.tail", "end.part")
    pieces = dealt.groupBy("tail", "part").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    told = dealt.join(pieces, ["tail", "part"]).withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
    met = told.withColumn("other", other).withColumn(
        "sides", F.least("piece", "other") * (1 << 20) + F.greatest("piece", "other")
    )
    found = (  # dealt anew, or all meetings of a group would stay in the partition that the join put it in
        met.select("tail", "part", "sides", "piece", "word", "n")
        .repartition("tail", "part", "sides")
        .groupBy("tail", "part", "sides")
        .applyInArrow(_meet, "word string, n_near bigint, best_n bigint, best string")
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))
    )


def variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of `vocabulary` (`word`, `n`; words of five code points or more)."""
    held = stored(vocabulary.select("word", "n"))
    fits = F.col("best_n") >= ratio * F.col("n")
    named = stored(
        held.join(near_words(held), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(fits, F.col("best")).alias("form"),
            F.when(fits, F.col("best_n")).alias("form_n"),
        )
    )
    # Counts double from form to form at least, so chains are short and end.
    ahead = stored(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(ahead.join(step, "root", "left").select("word", "root", "next"))
        ahead = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.where("next IS NOT NULL").isEmpty():
            break
    roots = named.join(ahead, "word", "left")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """The spelling variants among all words of `docs`."""
    if shortest < 2 * ENDS + 1:
        raise ValueError(f"words of fewer than {2 * ENDS + 1} code points may share neither end")
    return variants(vocabulary(runs(docs, key, text), shortest, least), ratio)
