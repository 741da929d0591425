"""N-gram Jaccard join of texts by parity sketches.

A text's set holds its distinct shingles of WIDTH words (all its words as one
shingle where there are fewer). Texts with equal sets are one class from the
start. Two sets of sizes a and b with Jaccard similarity 3/4 or more differ in at
most (a + b) / 7 shingles.

Sketches: sizes fall into bands, each a third wider than the one before, so
similar sets lie in one band or in neighbours. A band and the next one share a
table of sketches. In a table that admits D differences, shingles are dealt by
hash to blocks of a very wide bit sketch, each flipping one bit, and a block's
content is the XOR of the hashes of its bits. The Hamming distance of two
sketches is at most the number of differing shingles, so at most D blocks
differ. A set with more than D blocks that are not empty therefore shares a
block among the first D + 1 of them, in any order common to all sets, with every
similar set (pigeonhole over the blocks left); a set with fewer sends all of them
and meets others like it under a key of the table. The order puts blocks that a
sample of the texts shows to be frequent last. Every pair that meets is
verified on the whole sets.

Sets that share a block meet in pairs; a block of more than ALL_PAIRS sets first
meets its smallest set only. Once those links are grouped, blocks that still hold
several groups compare their members across groups, so no link between groups
is missed; within a group nothing is left to find.

Edge cases: null and empty texts have an empty set and link with nothing; rows
without a key link like others but cannot name a class; repeated rows are one
class; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.bits import bit_filter, holds
from stratocast.llm.components import components
from stratocast.llm.frequent import most_frequent
from stratocast.llm.names import renamed, set_apart
from stratocast.storage import stored

WIDTH = 5
ALL_PAIRS = 6
FLUSH = 1 << 19  # block keys that a task holds before it sends them
PER_BUCKET = 1 << 19  # block keys per group of the join, about
SAMPLE = 16  # one in so many texts tells which blocks are frequent
FREQUENT = 4  # sampled sets that share a frequent block
GROUP = 1024  # members of a block that are compared in one piece
MAX_FREQUENT = 200_000  # frequent blocks that are sorted last; the others only cost time
_SALT = np.uint64(0xA24BAED4963EE407)


def _edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges, np.int64)


EDGES = _edges()  # band i holds the sizes from EDGES[i] to EDGES[i + 1] - 1
_TOP = EDGES[1:] - 1
DIFFER = (_TOP + _TOP * 4 // 3) // 7  # differences that the table of bands i and i + 1 admits
BLOCKS = np.where(DIFFER == 0, 1, (DIFFER + 1) * 8 // 5 + 4)


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles' hashes, ascending, one text after another; and where each text's begin."""
    hashes, first = W.word_hashes(texts, True)
    counts = np.diff(first)
    grams, whole = W.grams(hashes, first, WIDTH)
    owner = np.repeat(np.arange(len(texts)), counts)
    ids, who = grams[whole], owner[whole]
    for i in np.flatnonzero((counts > 0) & (counts < WIDTH)):
        own = hashes[first[i] : first[i + 1]]
        ids = np.append(ids, W.grams(own, np.array([0, len(own)]), len(own))[0][0])
        who = np.append(who, i)
    order = np.lexsort((ids, who))
    ids, who = ids[order], who[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (who[1:] != who[:-1])
    ids, who = ids[new], who[new]
    return ids, np.searchsorted(who, np.arange(len(texts) + 1))


def set_ids(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set; 0 for an empty one."""
    sizes = np.diff(begin)
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(W.mixed(ids ^ _SALT), begin[:-1][full])
    out = W.mixed(out + sizes.astype(np.uint64)) >> np.uint64(1)
    out[~full] = 0
    return out.astype(np.int64)


def block_keys(ids: np.ndarray, begin: np.ndarray, frequent: np.ndarray, every: bool = False):
    """(set's place, key, role) for the blocks that each set sends.

    The role is odd in the upper band of the key's table; the rest of it is
    smaller the larger the share of frequent blocks among those sent, so a text
    in the midst of many near copies has the smallest.
    """
    sizes = np.diff(begin)
    who_all = np.repeat(np.arange(len(sizes)), sizes)
    band = np.searchsorted(EDGES, sizes, side="right") - 1
    out = []
    for upper in (0, 1):
        table = band - upper
        use = (sizes > 0) & (table >= 0)
        blocks = BLOCKS[np.maximum(table, 0)]
        other = np.minimum(sizes, _TOP[np.maximum(table, 0)]) if upper else sizes * 4 // 3
        differ = (sizes + other) // 7  # at most, to any similar set in this table
        keep = use[who_all]
        token, who = ids[keep], who_all[keep]
        if not len(token):
            continue
        spot = W.mixed(token + (table[who] + 1).astype(np.uint64) * _SALT)
        block = (spot >> np.uint64(32)) * blocks[who].astype(np.uint64) >> np.uint64(32)
        cell = (who.astype(np.uint64) << np.uint64(40)) | block
        order = np.argsort(cell, kind="stable")
        cell, bit = cell[order], W.mixed(spot[order] * _SALT)
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        content = np.bitwise_xor.reduceat(bit, start)
        cell = cell[start]
        who = (cell >> np.uint64(40)).astype(np.int64)
        block = cell & np.uint64((1 << 40) - 1)
        key = W.mixed(content + W.mixed(block + (table[who].astype(np.uint64) << np.uint64(40))))
        role = np.full(len(key), upper, np.uint8)
        if not every:
            late = np.zeros(len(key), bool)
            if len(frequent):
                late = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
            order = np.lexsort((key, late, who))
            key, who, late = key[order], who[order], late[order]
            first = np.searchsorted(who, np.arange(len(sizes)))
            early = np.arange(len(who)) - first[who] <= differ[who]
            key, who, late = key[early], who[early], late[early]
            sent = np.bincount(who, minlength=len(sizes))
            share = np.bincount(who, late, len(sizes)) / np.maximum(sent, 1)
            short = np.flatnonzero(use & (sent <= differ))
            key = np.concatenate([key, W.mixed(table[short].astype(np.uint64) ^ _SALT)])
            who = np.concatenate([who, short])
            role = (upper + 2 * np.rint(100 * (1 - share[who]))).astype(np.uint8)
        out.append((who, key, role))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*out))


def meeting(keys: np.ndarray, sets: np.ndarray, roles: np.ndarray):
    """Pairs of different sets that share a key, and (key, set, upper) of the keys whose sets met only a chosen one.

    The chosen one has the smallest role of the table's lower band. Pairs
    within the upper band are left to that band's own table.
    """
    order = np.lexsort((sets, roles, keys))
    keys, sets, roles = keys[order], sets[order], roles[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
    keys, sets, roles = keys[new], sets[new], roles[new]
    upper = roles % 2 == 1
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    left, right, large = [], [], []
    for n in range(2, ALL_PAIRS + 1):
        at = start[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                left.append(at + i)
                right.append(at + j)
    for at, n in zip(start[size > ALL_PAIRS], size[size > ALL_PAIRS]):
        group = np.arange(at, at + n)
        low = group[~upper[group]]
        if len(low):
            left.append(np.full(n, low[0]))
            right.append(group)
            large.append(group)
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) if x else none for x in (left, right))
    able = ~(upper[a] & upper[b]) & (sets[a] != sets[b])
    both = np.unique(np.sort(np.stack([sets[a[able]], sets[b[able]]], 1), axis=1), axis=0)
    more = np.concatenate(large) if large else none
    return both, keys[more].astype(np.int64), sets[more], upper[more]


def sketch(ids: np.ndarray) -> bytes:
    """A small parity sketch, of about two bits per shingle and of a length that neighbouring bands share."""
    bits = 1 << max(6, int(2 * len(ids)).bit_length())
    parity = np.bincount((W.mixed(ids + _SALT) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def may_link(a: int, b: int, one: bytes, two: bytes) -> bool:
    """Whether sizes and small sketches allow a similarity of 3/4."""
    if min(a, b) * 4 < max(a, b) * 3:
        return False
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    x, y = _folded(x, y)
    return int(np.bitwise_count(x ^ y).sum()) * 7 <= a + b


def _folded(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of one length: a longer one is folded by XOR, as if made shorter."""
    while x.shape[-1] > y.shape[-1]:
        x = _fold(x)
    while y.shape[-1] > x.shape[-1]:
        y = _fold(y)
    return x, y


def _fold(x: np.ndarray) -> np.ndarray:
    half = x.shape[-1] // 2
    return x[..., :half] ^ x[..., half:]


def _texts(batch: pa.RecordBatch):
    values = batch.column("_bytes").to_pylist()
    for a, b in W.slices(values):
        ids, begin = shingle_sets(values[a:b])
        yield a, b, ids, begin, set_ids(ids, begin)


def _fresh(names: np.ndarray, seen: set) -> np.ndarray:
    """Whether each set is new to this task; equal texts of a task are sent once."""
    return np.array([n != 0 and n not in seen and not seen.add(n) for n in names.tolist()], bool)


def _describe(batches):
    seen: set = set()
    for batch in batches:
        size, name, small = [], [], []
        for a, b, ids, begin, names in _texts(batch):
            fresh = _fresh(names, seen)
            size.append(np.diff(begin))
            name.append(names)
            small += [sketch(ids[begin[i] : begin[i + 1]]) if fresh[i] else None for i in range(b - a)]
        if size:
            arrays = [batch.column("_key"), pa.array(np.concatenate(size)), pa.array(np.concatenate(name)), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["_key", "n_shingles", "_set", "_sketch"])


def _sampled(batches):
    seen: set = set()
    none = np.zeros(0, np.uint64)
    for batch in batches:
        for _, _, ids, begin, names in _texts(batch):
            who, key, _ = block_keys(ids, begin, none, every=True)
            key = key[_fresh(names, seen)[who]]
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64))], ["key"])


def _send(batches, frequent: np.ndarray, buckets: int):
    seen: set = set()
    held, count = [], 0

    def flush():
        key, name, role = (np.concatenate(x) for x in zip(*held))
        bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for i in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            at = order[edge[i] : edge[i + 1]]
            rows.append((i, (key[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), name[at].tobytes(), role[at].tobytes()))
        columns = list(zip(*rows))
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "keys", "sets", "roles"])

    for batch in batches:
        for _, _, ids, begin, names in _texts(batch):
            who, key, role = block_keys(ids, begin, frequent)
            fresh = _fresh(names, seen)[who]
            held.append((key[fresh], names[who[fresh]], role[fresh]))
            count += int(fresh.sum())
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
    if count:
        yield flush()


def _meet(group: pa.Table) -> pa.Table:
    keys, sets, roles = (
        np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", np.uint32), ("sets", np.int64), ("roles", np.uint8))
    )
    both, key, member, upper = meeting(keys, sets, roles)
    bucket = np.int64(group.column("bucket")[0].as_py())
    block = (bucket << np.int64(32)) | key
    return pa.table({
        "a": np.concatenate([both[:, 0], member]),
        "b": np.concatenate([both[:, 1], np.zeros(len(member), np.int64)]),
        "block": pa.array(np.concatenate([np.zeros(len(both), np.int64), block]), mask=np.arange(len(both) + len(member)) < len(both)),
        "upper": np.concatenate([np.zeros(len(both), bool), upper]),
    })


def _able(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))
        keep = pa.array([may_link(*r) for r in rows], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _across(group: pa.Table) -> pa.Table:
    """Pairs of one piece's members from different groups that sizes and sketches allow."""
    size, name, root, piece, sides = (group.column(c).to_numpy() for c in ("n_shingles", "node", "root", "piece", "sides"))
    upper, small = group.column("upper").to_numpy(), group.column("sketch").to_pylist()
    length = np.array([len(x) for x in small])
    one, two = piece == sides % (1 << 20), piece == sides >> 20
    bytes_of = {n: np.stack([np.frombuffer(small[i], np.uint8) for i in np.flatnonzero(length == n)]) for n in np.unique(length)}
    place = np.zeros(len(small), np.int64)
    for n in bytes_of:
        place[length == n] = np.arange((length == n).sum())
    a, b = [], []
    for i in np.flatnonzero(one):
        for n, table in bytes_of.items():
            j = np.flatnonzero((length == n) & two & (root != root[i]) & ~(upper & upper[i]))
            j = j[(np.minimum(size[j], size[i]) * 4 >= np.maximum(size[j], size[i]) * 3) & ((name[j] > name[i]) | (sides[i] % (1 << 20) != sides[i] >> 20))]
            if len(j):
                x, y = _folded(np.frombuffer(small[i], np.uint8), table[place[j]])
                j = j[np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * 7 <= size[j] + size[i]]
                a.append(np.full(len(j), name[i]))
                b.append(name[j])
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate(a or none), np.concatenate(b or none)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _whole(batches, bits: np.ndarray):
    seen: set = set()
    for batch in batches:
        name, data = [], []
        for a, b, ids, begin, names in _texts(batch):
            hit = holds(bits, names)
            hit[hit] = _fresh(names[hit], seen)
            name += names[hit].tolist()
            data += [ids[begin[i] : begin[i + 1]].tobytes() for i in np.flatnonzero(hit)]
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(data, pa.binary())], ["set", "shingles"])


def _similar(batches):
    for batch in batches:
        keep = []
        for one, two in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * same >= 75 * (len(x) + len(y) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class NearJoin:
    """The steps of the join over one table of texts."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.spark = docs.sparkSession
        self.texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_bytes"))
        kind = self.texts.schema["_key"].dataType.simpleString()
        self.sets = stored(
            self.texts.mapInArrow(_describe, f"_key {kind}, n_shingles bigint, _set bigint, _sketch binary")
        )
        self.nodes = stored(
            self.sets.where("_set <> 0")
            .groupBy(F.col("_set").alias("node"))
            .agg(F.min("_key").alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("_sketch").alias("sketch"))
        )

    def frequent(self) -> np.ndarray:
        """The blocks that are frequent in a sample of the texts; at most MAX_FREQUENT, ascending."""
        sample = self.texts.where(F.pmod(F.xxhash64("_bytes"), F.lit(SAMPLE)) == 0).select("_bytes")
        keys = sample.mapInArrow(_sampled, "key bigint").groupBy("key").count().where(F.col("count") >= FREQUENT)
        rows = most_frequent(stored(keys), "count", MAX_FREQUENT).select("key").collect()
        return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))

    def meet(self) -> DataFrame:
        """Pairs (a, b) of sets to look at, and members (a, block, upper) of large blocks."""
        shared = self.spark.sparkContext.broadcast(self.frequent())
        total = self.nodes.agg(F.sum("n_shingles")).first()[0] or 0
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(parts, int(total * 0.6 / PER_BUCKET) + 1)
        sent = self.texts.select("_bytes").mapInArrow(
            lambda batches: _send(batches, shared.value, buckets), "bucket int, keys binary, sets binary, roles binary"
        )
        return stored(sent.groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint, block bigint, upper boolean"))

    def able(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and small sketches allow."""
        one = self.nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        two = self.nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        near = pairs.distinct().join(one, "a").join(two, "b").where("least(na, nb) * 4 >= greatest(na, nb) * 3")
        return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_able, "a bigint, b bigint")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough; only texts of such pairs are read again."""
        pairs = stored(pairs)
        names = stored(pairs.select("a").union(pairs.select("b")).distinct())
        shared = self.spark.sparkContext.broadcast(bit_filter(names, "a", names.count()))
        read = self.texts.select("_bytes").mapInArrow(lambda b: _whole(b, shared.value), "set bigint, shingles binary")
        whole = stored(read.join(names, read["set"] == names["a"], "left_semi").groupBy("set").agg(F.max("shingles").alias("x")))
        met = pairs.join(whole.select(F.col("set").alias("a"), F.col("x").alias("xa")), "a").join(
            whole.select(F.col("set").alias("b"), F.col("x").alias("xb")), "b"
        )
        return stored(met.select("a", "b", "xa", "xb").mapInArrow(_similar, "a bigint, b bigint"))

    def across(self, met: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs that large blocks may still hide: members of one block that the links so far leave in different groups."""
        roots = stored(components(links, "a", "b"))
        members = met.where("block IS NOT NULL").select("block", F.col("a").alias("node"), "upper")
        members = stored(
            members.join(roots, "node", "left").select("block", "node", "upper", F.coalesce("root", "node").alias("root"))
        )
        mixed = stored(
            members.groupBy("block")
            .agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
            .where("low <> high")
            .select("block", F.ceil(F.col("n") / GROUP).alias("pieces"))
        )
        told = members.join(mixed, "block").join(self.nodes.select("node", "n_shingles", "sketch"), "node")
        piece = F.pmod(F.xxhash64("node"), F.col("pieces"))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
        dealt = (
            told.withColumn("piece", piece)
            .withColumn("_other", other)
            .withColumn("sides", F.least("piece", "_other") + F.greatest("piece", "_other") * (1 << 20))
            .drop("_other", "pieces")
        )
        return dealt.groupBy("block", "sides").applyInArrow(_across, "a bigint, b bigint").distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_shingles, component_id (the smallest key reachable by links)."""
    join = NearJoin(docs, key, text)
    met = join.meet()
    links = join.verified(join.able(met.where("block IS NULL").select("a", "b")))
    more = join.verified(join.across(met, links))
    roots = stored(components(links.union(more), "a", "b"))
    classes = join.nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(classes.join(least, "root").select(F.col("node").alias("_set"), "component_id"))
    return join.sets.join(named, "_set", "left").select(
        F.col("_key").alias(key), "n_shingles", F.coalesce("component_id", "_key").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that name their class, each once; rows without a key are kept as they are."""
    docs, own = set_apart(docs)
    key, text = renamed(own, key, text)
    found = near_classes(docs, key, text).where(F.col(key) == F.col("component_id"))
    kept = found.groupBy(F.col(key).alias("_kept")).agg(F.count(F.lit(1)).alias("_times"))
    met = docs.join(kept, F.col(key) == F.col("_kept"))
    once = met.where("_times = 1").select(*docs.columns)
    twice = met.where("_times > 1").select(*docs.columns).dropDuplicates([key, text])
    return once.unionByName(twice).unionByName(docs.where(F.col(key).isNull())).withColumnsRenamed(own)
