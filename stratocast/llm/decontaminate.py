"""Benchmark decontamination: a BM25 index of test items, searched by every passage with block-max WAND.

Words are runs of letters and digits (any byte but ASCII blanks and punctuation),
A-Z lower-cased. A text is cut into passages of twice `half` words that overlap
by half, where `half` is the longest item's length or MIN_HALF, so an item that
stands in a text lies whole in some passage. Each posting's BM25 weight is
divided by its item's score for itself, so a passage that holds all of an item's
words scores 1. Every passage queries the index; all items that score `threshold`
or more are retrieved. A retrieved item counts when shares of the word n-grams of
its question (all sentences but the last) and of its answer (the last sentence)
stand in the passage. An item of one sentence is halved.

Document frequencies and the mean length are counted over all different items
(an item is its id and text). The index is cut into shards, which bound memory
and nothing else: an item's weights, its passages (their half is the power of two
at or above the item's own length) and its n-grams do not depend on the items it
lies with. Tasks build the shards and write them to the shared folder. A pass over
the documents searches up to PASS shards, which are broadcast and opened one at a
time; more shards are further passes over what the pass before wrote. In a shard,
block maxima of fixed ranges of items are first added up for all passages at once;
most passages cannot reach the threshold in any range and end there.

Edge cases: null and empty texts hold nothing; items without words are found
nowhere; a document that holds an item without an id is contaminated, but the
item is in no list; equal items are all found, repeated ones listed once; ids that
are not whole numbers are listed as strings; an empty table of items leaves all
documents clean; repeated rows are judged one by one; columns of the input that
carry the name of a result column are replaced by it, all others stay.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterable, Iterator
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.llm import words as W
from stratocast.llm.names import free_name
from stratocast.storage import stored

MIN_HALF = 64
K1, B = 1.2, 0.75
BLOCK = 32  # postings per block
RANGES = 64  # ranges of items whose bounds are added up for all passages at once
GRAM = 3
PASS = 16  # shards that one pass over the documents searches
OPEN = 2  # shards that a task keeps open; of more it opens one at a time
SLICES = 16  # slices of texts whose words a task holds at a time
END = 1 << 62
ADDED = ("contaminated", "items")
_SENTENCE = re.compile(rb"[.!?\n]+")


@dataclass
class Index:
    """Postings by term: items (ascending), weights, block maxima; and each item's id, question and answer n-grams."""

    terms: np.ndarray
    bounds: list
    postings: list
    grams: dict
    half: int

    def ranges(self) -> np.ndarray:
        """Each term's largest weight within each of RANGES equal ranges of items."""
        out = np.zeros((len(self.terms), RANGES), np.float32)
        for row, (ids, weights, _) in enumerate(self.postings):
            np.maximum.at(out[row], np.array(ids) * RANGES // len(self.grams), np.array(weights, np.float32))
        return out


@dataclass
class Counts:
    """Of all items: their number, their mean length, and in how many of them each term stands."""

    items: int
    mean: float
    df: dict


def half_of_length(length: int) -> int:
    """Half a passage for items of a length: a power of two, so that few kinds of passages are needed."""
    return max(MIN_HALF, 1 << max(0, length - 1).bit_length())


def _hashes(text: bytes) -> np.ndarray:
    return W.word_hashes([text], True, W.GAPS_AND_MARKS)[0]


def _gram_set(hashes: np.ndarray) -> frozenset:
    n = min(GRAM, len(hashes))
    return frozenset(W.grams(hashes, np.array([0, len(hashes)]), n)[0][: len(hashes) - n + 1].tolist()) if n else frozenset()


def question_and_answer(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of an item's question and of its answer."""
    parts = [h for h in map(_hashes, _SENTENCE.split(text)) if len(h)]
    if len(parts) > 1:
        return np.concatenate(parts[:-1]), parts[-1]
    alone = parts[0] if parts else np.zeros(0, np.uint64)
    return alone[: (len(alone) + 1) // 2], alone[(len(alone) + 1) // 2 :]


def counts_of(texts: list[bytes]) -> Counts:
    """Counts of items that fit into memory."""
    bags = [Counter(_hashes(t).tolist()) for t in texts]
    lengths = [sum(bag.values()) for bag in bags if bag]
    return Counts(len(lengths), sum(lengths) / max(1, len(lengths)), Counter(term for bag in bags for term in bag))


def build_index(items: list[tuple], counts: Counts | None = None) -> Index:
    """The index of one shard; items are (id, text), `counts` are those of all shards (None: it is the only one)."""
    counts = counts or counts_of([t for _, t in items])
    lists, grams, longest = defaultdict(list), {}, 0
    for i, text in items:
        bag = Counter(_hashes(text).tolist())
        n = sum(bag.values())
        if not n:
            continue
        longest = max(longest, n)
        raw = {}
        for t, tf in bag.items():
            idf = math.log(1 + (counts.items - counts.df[t] + 0.5) / (counts.df[t] + 0.5))
            raw[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / counts.mean))
        total = math.fsum(raw.values())
        for t, w in raw.items():
            lists[t].append((len(grams), w / total))
        question, answer = question_and_answer(text)
        grams[len(grams)] = (i, _gram_set(question), _gram_set(answer))
    terms = np.array(sorted(lists), np.uint64)
    postings = []
    for t in terms.tolist():
        ids, weights = [i for i, _ in lists[t]], [w for _, w in lists[t]]
        maxima = [max(weights[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
        postings.append((ids, weights, maxima))
    return Index(terms, [max(p[2]) for p in postings], postings, grams, half_of_length(longest))


def retrieve(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with score >= threshold for a query of distinct terms, by block-max WAND."""
    found, floor = [], threshold - 1e-9
    heads = [[index.postings[t][0][0], 0, t] for t in terms]  # item, place, term
    while heads:
        heads.sort()
        total, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(heads):
            total += index.bounds[t]
            if total >= floor:
                pivot = k
                break
        if pivot < 0:
            break
        item = heads[pivot][0]
        while pivot + 1 < len(heads) and heads[pivot + 1][0] == item:
            pivot += 1
        # Block maxima of the lists that can hold the pivot item; `until` is where the first of these blocks ends.
        ceiling, until = 0.0, END
        for head in heads[: pivot + 1]:
            ids, _, maxima = index.postings[head[2]]
            block = _seek(ids, head[1], item) // BLOCK
            if block < len(maxima):
                ceiling += maxima[block]
                until = min(until, ids[min(len(ids), (block + 1) * BLOCK) - 1] + 1)
        if ceiling >= floor:
            parts = []
            for head in heads[: pivot + 1]:
                ids, weights, _ = index.postings[head[2]]
                at = _seek(ids, head[1], item)
                if at < len(ids) and ids[at] == item:
                    parts.append(weights[at])
            score = math.fsum(parts)  # the same in any order
            if score >= floor:
                found.append((item, score))
            target = item + 1
        else:
            target = max(item + 1, min(until, heads[pivot + 1][0] if pivot + 1 < len(heads) else END))
        kept = []
        for k, head in enumerate(heads):
            if k <= pivot:
                ids = index.postings[head[2]][0]
                head[1] = _seek(ids, head[1], target)
                if head[1] >= len(ids):
                    continue
                head[0] = ids[head[1]]
            kept.append(head)
        heads = kept
    return found


def _seek(ids: list[int], at: int, item: int) -> int:
    """The first place from `at` on whose id is `item` or more, by doubling steps."""
    step, low = 1, at
    while at < len(ids) and ids[at] < item:
        low, at, step = at + 1, at + step, step * 2
    high = min(at, len(ids))
    while low < high:
        middle = (low + high) // 2
        if ids[middle] < item:
            low = middle + 1
        else:
            high = middle
    return low


def _share(part: frozenset, there: set) -> float:
    return len(part & there) / len(part) if part else 1.0


def _found_in(index: Index, ranges: np.ndarray, hashes: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple]:
    """(text, item id) for the items that a slice of texts holds, given its words and each text's first."""
    counts = np.diff(first)
    term = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[term] == hashes)
    halves = -(-counts // index.half)
    begin = np.concatenate([[0], np.cumsum(halves)])
    text_of = np.repeat(np.arange(len(counts)), counts)
    half_of = begin[text_of] + (np.arange(len(hashes)) - first[text_of]) // index.half
    pairs = np.unique(half_of[known] * len(index.terms) + term[known])
    edge = np.searchsorted(pairs // len(index.terms), np.arange(begin[-1] + 1))
    bound = np.zeros((begin[-1] + 1, RANGES), np.float32)
    held = np.flatnonzero(edge[1:] > edge[:-1])
    if len(held):
        bound[held] = np.add.reduceat(ranges[pairs % len(index.terms)], edge[held])
    last = np.zeros(begin[-1] + 1, bool)
    last[begin[1:][halves > 0] - 1] = True
    bound[:-1][~last[:-1]] += bound[1:][~last[:-1]]  # a passage is a half and the next one
    # A text's last half is a passage only where it is the first, too.
    alone = np.zeros(begin[-1] + 1, bool)
    alone[begin[:-1][halves == 1]] = True
    able = bound.max(axis=1) >= threshold - 1e-4
    able[-1] = False
    for half in np.flatnonzero(able & (~last | alone)).tolist():
        end = half + (1 if last[half] else 2)
        query = np.unique(pairs[edge[half] : edge[end]] % len(index.terms)).tolist()
        hits = retrieve(index, query, threshold)
        if not hits:
            continue
        row = int(np.searchsorted(begin, half, side="right")) - 1
        low = first[row] + (half - begin[row]) * index.half
        passage = hashes[low : min(low + 2 * index.half, first[row + 1])]
        there = set()
        for n in range(1, GRAM + 1):
            if len(passage) >= n:
                there.update(W.grams(passage, np.array([0, len(passage)]), n)[0][: len(passage) - n + 1].tolist())
        for item, _ in hits:
            name, question, answer = index.grams[item]
            if _share(question, there) >= overlap and _share(answer, there) >= overlap:
                yield row, name


def find_items(texts: list, indexes: Iterable[Index], threshold: float, overlap: float) -> list[set]:
    """For each text (bytes or None) the ids of the items it holds; `indexes` is gone through once for some slices."""
    out: list[set] = [set() for _ in texts]
    cuts = list(W.slices(texts))
    for k in range(0, len(cuts), SLICES):
        hashed = [(a, *W.word_hashes(texts[a:b], True, W.GAPS_AND_MARKS)) for a, b in cuts[k : k + SLICES]]
        hashed = [x for x in hashed if len(x[1])]
        for index in indexes if hashed else ():
            ranges = index.ranges()
            for a, hashes, first in hashed:
                for row, name in _found_in(index, ranges, hashes, first, threshold, overlap):
                    out[a + row].add(name)
    return out


class _Shards:
    """Pickled indexes, opened one at a time unless they are few."""

    def __init__(self, blobs: list[bytes]):
        self.blobs = blobs
        self.opened = [pickle.loads(x) for x in blobs] if len(blobs) <= OPEN else None

    def __iter__(self) -> Iterator[Index]:
        return iter(self.opened) if self.opened is not None else map(pickle.loads, self.blobs)


def _terms(batches):
    """Each item's length and different words."""
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        lengths, terms = [], []
        for a, b in W.slices(texts):
            hashes, first = W.word_hashes(texts[a:b], True, W.GAPS_AND_MARKS)
            lengths += np.diff(first).tolist()
            terms += [np.unique(hashes[x:y]).view(np.int64) for x, y in zip(first[:-1], first[1:])]
        columns = [batch.column("_key"), batch.column("_text"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["_key", "_text", "_length", "_terms"])


def _is_whole(items: DataFrame, key: str) -> bool:
    return isinstance(items.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def build_shards(items: DataFrame, key: str, text: str, max_items: int, max_bytes: int) -> tuple[DataFrame | None, int]:
    """A stored table (shard, index) of pickled indexes, and the number of shards.

    Items of one length class lie in as many shards, by hash, as leave each half full on average.
    """
    plain = items.select(F.col(key).cast("bigint" if _is_whole(items, key) else "string").alias("_key"), F.col(text).cast("binary").alias("_text"))
    plain = plain.where("_text IS NOT NULL").distinct()
    schema = T.StructType([*plain.schema, T.StructField("_length", T.LongType()), T.StructField("_terms", T.ArrayType(T.LongType()))])
    rows = stored(plain.mapInArrow(_terms, schema).where("_length > 0"))
    # The exponent of the power of two at or above the length.
    bits = F.greatest(F.lit(MIN_HALF.bit_length() - 1), F.length(F.bin(F.col("_length") - 1)))
    rows = rows.withColumn("_class", bits.cast("int"))
    classes = rows.groupBy("_class").agg(  # one row for a power of two
        F.count("*").alias("n"), F.sum("_length").alias("words"), F.sum(F.length("_text")).alias("bytes")
    )
    shard, n_shards, n_items, n_words = F.lit(None).cast("int"), 0, 0, 0
    for c in classes.orderBy("_class").collect():
        fits = c["n"] <= max_items and c["bytes"] <= max_bytes
        n = 1 if fits else max(-(-2 * c["n"] // max_items), -(-2 * c["bytes"] // max_bytes))
        place = F.pmod(F.xxhash64("_key", "_text"), F.lit(n)).cast("int") + n_shards
        shard = F.when(F.col("_class") == c["_class"], place).otherwise(shard)
        n_shards, n_items, n_words = n_shards + n, n_items + c["n"], n_words + c["words"]
    if not n_shards:
        return None, 0
    rows = rows.withColumn("_shard", shard)
    terms = rows.select("_shard", F.explode("_terms").alias("_term"))
    df = terms.groupBy("_term").agg(F.count("*").alias("_n"))
    needed = terms.distinct().join(df, "_term").withColumnRenamed("_shard", "_of")

    def build(here: pa.Table, terms: pa.Table) -> pa.Table:
        numbers = terms.column("_term").to_numpy().view(np.uint64).tolist()
        counts = Counts(n_items, n_words / n_items, dict(zip(numbers, terms.column("_n").to_pylist())))
        texts = here.column("_text").to_pylist()
        members = sorted(zip(here.column("_key").to_pylist(), texts), key=lambda x: (x[1], str(x[0])))
        index = pickle.dumps(build_index(members, counts), pickle.HIGHEST_PROTOCOL)
        return pa.table({"shard": pa.array(here.column("_shard").to_pylist()[:1], pa.int32()), "index": pa.array([index], pa.binary())})

    members = rows.select("_shard", "_key", "_text").groupBy("_shard")
    return stored(members.cogroup(needed.groupBy("_of")).applyInArrow(build, "shard int, index binary")), n_shards


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.75,
    overlap: float = 0.6,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    max_items: int = 2_000,
    max_bytes: int = 1_000_000,
) -> DataFrame:
    """All rows of `docs` with contaminated (boolean) and items (sorted ids of the items that the text holds).

    `max_items` and `max_bytes` bound a shard on average; they change no result.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    body = free_name(docs.columns, "bytes")
    built, n_shards = build_shards(items, item_key, item_text, max_items, max_bytes)
    whole = _is_whole(items, item_key)
    listed, arrow = (T.LongType(), pa.int64()) if whole else (T.StringType(), pa.string())
    none = F.array().cast(T.ArrayType(listed))
    out = docs.select(*kept, F.lit(False).alias("contaminated"), none.alias("items"))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(listed))])
    for low in range(0, n_shards, PASS):
        part = built.where(F.col("shard").between(low, low + PASS - 1)).orderBy("shard").collect()  # PASS shards of bounded size
        shared = docs.sparkSession.sparkContext.broadcast([bytes(r["index"]) for r in part])

        def run(batches, shared=shared):
            indexes = _Shards(shared.value)
            for batch in batches:
                found = find_items(batch.column(body).to_pylist(), indexes, threshold, overlap)
                flags = [bool(x or y) for x, y in zip(batch.column("contaminated").to_pylist(), found)]
                lists = [sorted({*x, *(y - {None})}) for x, y in zip(batch.column("items").to_pylist(), found)]
                columns = [*(batch.column(c) for c in kept), pa.array(flags, pa.bool_()), pa.array(lists, pa.list_(arrow))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "contaminated", "items"])

        out = out.withColumn(body, F.col(text).cast("binary")).mapInArrow(run, schema)
        if low + PASS < n_shards:
            out = stored(out)  # so that no more than one pass's shards are alive
            shared.unpersist()
    return out
