"""Removal of word sequences that stand earlier in the corpus, by prefix-partitioned suffix trees.

A window is LENGTH consecutive words of one text. Each word that lies in a window
whose words also start earlier (smaller key, or earlier in the same text) is
removed.

1. Texts with equal words: the one with the smallest key stands for all; every
   window of the others stands earlier in it.
2. Anchors: of the GRAM-word hashes in a window the smallest is its anchor, so
   equal windows have equal anchors. Anchors found twice, anywhere, go into a
   filter of fixed size; a window whose anchor it does not hold stands once.
3. Suffixes: the windows left are suffixes of the corpus cut off after LENGTH
   words, told by the hashes of their STEP-word pieces. A task keeps the first
   of the equal suffixes it sees and reports the others at once. The rest is
   dealt by prefix: by the first piece, or where a sample shows that many
   suffixes begin with it, by as many pieces as it takes.
4. In each part the sorted suffixes are the leaves of a suffix tree, and runs
   that agree in all pieces are its inner nodes of depth LENGTH. All leaves of
   such a node but the earliest are reported.

Edge cases: null and empty texts have no words and keep the hash of nothing;
rows without a key come after all others; keys are
unique but for repeated rows, which are one text and each get its result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.bits import bit_filter, holds
from stratocast.llm.frequent import most_frequent
from stratocast.storage import stored

LENGTH = 20
GRAM = 8
STEP = 4
PIECES = LENGTH // STEP
FLUSH = 1 << 19  # anchors or suffixes that a task holds
PER_PART = 1 << 18  # suffixes in a part, about
SAMPLE = 16  # one in so many texts tells which prefixes are frequent
MAX_PREFIXES = 100_000  # frequent prefixes that are split; the others only make larger parts
LAST = (1 << 63) - 1


def _texts(batch: pa.RecordBatch):
    """Slices of a batch: keys, word hashes, first words, and a hash of each text's words."""
    keys, values = batch.column("_key").to_numpy(), batch.column("_bytes").to_pylist()
    for a, b in W.slices(values):
        hashes, first = W.word_hashes(values[a:b], False)
        at = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mixed(hashes + W.mixed(at.astype(np.uint64))))])
        whole = W.mixed(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(np.uint64))
        yield keys[a:b], hashes, first, whole.astype(np.int64)


def _tags(keys: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return W.mixed(keys.astype(np.uint64) ^ W.mixed(whole.astype(np.uint64))).astype(np.int64)


def _describe(batches):
    for batch in batches:
        for keys, _, first, whole in _texts(batch):
            arrays = [pa.array(x) for x in (keys, np.diff(first), whole, _tags(keys, whole))]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "n_words", "_whole", "_tag"])


def _doubtful(batches, copies: np.ndarray):
    """The rows that the filter of copies lets through, with their tags."""
    for batch in batches:
        tags = [_tags(k, w) for k, _, _, w in _texts(batch)]
        tag = np.concatenate(tags) if tags else np.zeros(0, np.int64)
        hit = pa.array(holds(copies, tag))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tag)], ["_key", "_bytes", "_tag"]).filter(hit)


def _windows(hashes: np.ndarray, first: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of the texts in use, their anchors, and where these stand (the leftmost of equals)."""
    grams, _ = W.grams(hashes, first, GRAM)
    _, whole = W.grams(hashes, first, LENGTH)
    whole &= np.repeat(use, np.diff(first))
    start = np.flatnonzero(whole)
    if not len(start):
        return start, np.zeros(0, np.uint64), start
    wide = np.lib.stride_tricks.sliding_window_view(grams, LENGTH - GRAM + 1)
    least, place = wide[:, 0].copy(), np.zeros(len(wide), np.int64)
    for k in range(1, wide.shape[1]):
        less = wide[:, k] < least
        least[less], place[less] = wide[less, k], k
    return start, least[start], start + place[start]


def _used(keys, whole, copies: np.ndarray | None) -> np.ndarray:
    return np.ones(len(keys), bool) if copies is None else ~holds(copies, _tags(keys, whole))


def _send_anchors(batches, copies, buckets: int):
    held, count = [], 0

    def flush():
        anchor = np.concatenate(held)
        anchor.sort()
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        start = np.flatnonzero(new)
        twice = np.diff(np.append(start, len(anchor))) > 1
        anchor = anchor[start]
        bucket = (anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        at = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
        values = [anchor[edge[i] : edge[i + 1]].tobytes() for i in at]
        flags = [twice[edge[i] : edge[i + 1]].tobytes() for i in at]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values), pa.array(flags)], ["bucket", "anchors", "twice"])

    for batch in batches:
        for keys, hashes, first, whole in _texts(batch):
            start, anchor, place = _windows(hashes, first, _used(keys, whole, copies))
            if not len(start):
                continue
            new = np.concatenate([[True], place[1:] != place[:-1]])  # windows that share a place are neighbours
            held.append(anchor[new])
            count += len(held[-1])
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
    if count:
        yield flush()


def _repeated(group: pa.Table) -> pa.Table:
    anchor = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()])
    twice = np.concatenate([np.frombuffer(x, bool) for x in group.column("twice").to_pylist()])
    order = np.argsort(anchor, kind="stable")
    anchor, twice = anchor[order], twice[order]
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(start, len(anchor)))
    many = (size > 1) | np.logical_or.reduceat(twice, start)
    return pa.table({"anchor": anchor[start[many]].astype(np.int64)})


def _suffixes(batch: pa.RecordBatch, copies, anchors: np.ndarray):
    """Keys, places and pieces of the suffixes that may stand twice."""
    for keys, hashes, first, whole in _texts(batch):
        start, anchor, _ = _windows(hashes, first, _used(keys, whole, copies))
        start = start[holds(anchors, anchor)]
        if len(start):
            piece = W.grams(hashes, first, STEP)[0]
            text = np.searchsorted(first, start, side="right") - 1
            pieces = np.stack([piece[start + k * STEP] >> np.uint64(32) for k in range(PIECES)], 1).astype(np.uint32)
            yield keys[text], (start - first[text]).astype(np.int32), pieces


def _prefixes(pieces: np.ndarray) -> np.ndarray:
    """The hash of each suffix's first 1, 2, ... pieces."""
    out = np.zeros(pieces.shape, np.uint64)
    run = np.zeros(len(pieces), np.uint64)
    for k in range(PIECES):
        run = W.mixed(run + pieces[:, k].astype(np.uint64) + np.uint64(k + 1))
        out[:, k] = run
    return out


def _sampled(batches, anchors: np.ndarray):
    for batch in batches:
        for _, _, pieces in _suffixes(batch, None, anchors):
            yield pa.RecordBatch.from_arrays([pa.array(_prefixes(pieces)[:, :-1].ravel().astype(np.int64))], ["prefix"])


def _first_of_equals(keys: np.ndarray, places: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by pieces, key and place; and which of them are not the first of their node."""
    order = np.lexsort((places, keys, *[pieces[:, k] for k in range(PIECES - 1, -1, -1)]))
    sorted_ = pieces[order]
    later = np.zeros(len(order), bool)
    later[1:] = (sorted_[1:] == sorted_[:-1]).all(axis=1)
    # The same place of one text, sent twice, is one leaf.
    k, p = keys[order], places[order]
    begin = np.flatnonzero(~later)
    node = np.cumsum(~later) - 1
    return order, later & ((k != k[begin][node]) | (p != p[begin][node]))


def _packed(keys: np.ndarray, places: np.ndarray, buckets: int) -> tuple[list, list, list]:
    """Reported windows by bucket of their text: bucket, keys and places."""
    bucket = ((W.mixed(keys.astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
    at = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
    rows = [by[edge[i] : edge[i + 1]] for i in at]
    return at, [keys[r].tobytes() for r in rows], [places[r].tobytes() for r in rows]


def _send_suffixes(batches, copies, anchors: np.ndarray, frequent: np.ndarray, parts: int, buckets: int):
    """Suffixes by part; and, by parts beyond the last, windows that are reported already."""
    held, count = [], 0

    def flush():
        keys, places, pieces = (np.concatenate(x) for x in zip(*held))
        order, later = _first_of_equals(keys, places, pieces)
        at, some, where = _packed(keys[order[later]], places[order[later]], buckets)
        keep = order[~later]
        prefix = _prefixes(pieces[keep])
        name = prefix[:, 0].copy()
        for k in range(PIECES - 1):  # a longer prefix where this one is frequent
            often = _member(frequent, prefix[:, k]) & (name == prefix[:, k])
            name[often] = prefix[often, k + 1]
        part = ((name >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[by], np.arange(parts + 1))
        to = np.flatnonzero(edge[1:] > edge[:-1]).tolist()
        rows = [keep[by[edge[i] : edge[i + 1]]] for i in to]
        columns = [
            pa.array([parts + i for i in at] + to, pa.int32()),
            pa.array(some + [keys[r].tobytes() for r in rows], pa.binary()),
            pa.array(where + [places[r].tobytes() for r in rows], pa.binary()),
            pa.array([None] * len(at) + [pieces[r].tobytes() for r in rows], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "keys", "places", "pieces"])

    for batch in batches:
        for found in _suffixes(batch, copies, anchors):
            held.append(found)
            count += len(found[0])
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
    if count:
        yield flush()


def _member(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(values), bool)
    return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values


def _joined(group: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(column).to_pylist()), kind)


def _tree(group: pa.Table, parts: int, buckets: int) -> pa.Table:
    """The windows of one part that stand earlier; or those of one bucket that were reported before."""
    keys, places = _joined(group, "keys", np.int64), _joined(group, "places", np.int32)
    if group.column("part")[0].as_py() < parts:
        order, later = _first_of_equals(keys, places, _joined(group, "pieces", np.uint32).reshape(-1, PIECES))
        keys, places = keys[order[later]], places[order[later]]
    at, some, where = _packed(keys, places, buckets)
    return pa.table([pa.array(at, pa.int32()), pa.array(some, pa.binary()), pa.array(where, pa.binary())], ["bucket", "keys", "places"])


def _by_text(group: pa.Table) -> pa.Table:
    """One row per text with the places of its windows that stand earlier."""
    keys, places = _joined(group, "keys", np.int64), _joined(group, "places", np.int32)
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    values = [places[a:b].tobytes() for a, b in zip(start, np.append(start[1:], len(keys)))]
    return pa.table([pa.array(keys[start], pa.int64()), pa.array(values, pa.binary())], ["_key", "places"])


def _kept(batches):
    """n_words, n_removed and the hash of the kept words."""
    for batch in batches:
        removed, digest, size = [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("_bytes", "_copy", "places")))
        for text, copy, places in rows:
            words = (text or b"").split()
            size.append(len(words))
            if copy and len(words) >= LENGTH:
                removed.append(len(words))
                words = []
            elif places:
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.frombuffer(places, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + LENGTH, -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed.append(int((~keep).sum()))
                words = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                removed.append(0)
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        arrays = [batch.column("_own"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["_own", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_words, n_removed, kept_sha256 (of the kept words joined by blanks)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    read = docs.select(F.col(key).alias("_own"), F.col(text).cast("binary").alias("_bytes"))
    nameless = F.lit(LAST) - F.xxhash64("_bytes").bitwiseAND((1 << 40) - 1)
    texts = read.select("_own", F.coalesce(F.col("_own").cast("bigint"), nameless).alias("_key"), "_bytes")
    given = texts.select("_key", "_bytes")
    told = stored(given.mapInArrow(_describe, "_key bigint, n_words bigint, _whole bigint, _tag bigint"))
    firsts = told.groupBy("_whole", "n_words").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    groups = stored(firsts.where("_first < _last"))
    copies = stored(told.join(groups, ["_whole", "n_words"]).where("_key > _first").select("_key", "_tag").distinct())
    copy_bits = share(bit_filter(copies, "_tag", copies.count()))
    doubtful = given.mapInArrow(lambda b: _doubtful(b, copy_bits.value), "_key bigint, _bytes binary, _tag bigint")
    rest = stored(doubtful.join(copies, ["_key", "_tag"], "left_anti").select("_key", "_bytes"))

    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_words = told.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(shuffled, int(n_words / 7 / PER_PART) + 1)
    schema = "bucket int, anchors binary, twice binary"
    anchors = given.mapInArrow(lambda b: _send_anchors(b, copy_bits.value, buckets), schema).unionByName(
        rest.mapInArrow(lambda b: _send_anchors(b, None, buckets), schema)
    )
    repeated = stored(anchors.groupBy("bucket").applyInArrow(_repeated, "anchor bigint"))
    anchor_bits = share(bit_filter(repeated, "anchor", repeated.count()))

    sample = given.where(F.pmod(F.xxhash64("_bytes"), F.lit(SAMPLE)) == 0)
    prefixes = sample.mapInArrow(lambda b: _sampled(b, anchor_bits.value), "prefix bigint").groupBy("prefix").count()
    often = stored(prefixes.where(F.col("count") >= PER_PART // SAMPLE // 2))
    rows = most_frequent(often, "count", MAX_PREFIXES).select("prefix").collect()
    frequent = share(np.sort(np.array([r["prefix"] for r in rows], np.int64).view(np.uint64)))

    parts = max(shuffled, int(n_words / 4 / PER_PART) + 1)
    to = max(shuffled, n_words >> 22)
    schema = "part int, keys binary, places binary, pieces binary"
    sent = given.mapInArrow(
        lambda b: _send_suffixes(b, copy_bits.value, anchor_bits.value, frequent.value, parts, to), schema
    ).unionByName(
        rest.mapInArrow(lambda b: _send_suffixes(b, None, anchor_bits.value, frequent.value, parts, to), schema)
    )
    trees = sent.groupBy("part").applyInArrow(lambda t: _tree(t, parts, to), "bucket int, keys binary, places binary")
    by_text = stored(trees.groupBy("bucket").applyInArrow(_by_text, "_key bigint, places binary"))
    own = texts.select(F.col("_own"), "_key", "_bytes")
    whole_copies = copies.select("_key", F.lit(True).alias("_copy")).distinct()
    joined = (
        own.join(by_text, "_key", "left")
        .join(whole_copies, "_key", "left")
        .select("_own", "_bytes", F.coalesce("_copy", F.lit(False)).alias("_copy"), "places")
    )
    kind = docs.schema[key].dataType.simpleString()
    out = joined.mapInArrow(_kept, f"_own {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumnRenamed("_own", key)
