"""Scores of texts by a log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

Tokens are words, A-Z lower-cased, and one end after each text. The MANY most
frequent tokens are outputs with vectors of their own; rarer ones are dealt by
hash to classes, one for about TAIL of them, which are outputs too, and within
such a class a token has its smoothed share of the training tokens. The last
CONTEXT tokens' vectors, weighted by position, are added up. The softmax has three
levels: the SHORT most frequent outputs and groups of the others by frequency;
subgroups of a group; outputs of a subgroup. All are computed in full by matrix
products, so probabilities are normalised.

Token counts are exact, over all training texts. Training starts from the counts
(all vectors near zero) and passes once over all training texts in ROUNDS: in
each every task trains its own copy on the texts it reads, and each vector is
averaged over the copies that changed it, weighted by how often they did. Counts
of the MANY most frequent tokens are broadcast; the others of each text are
looked up by a join.

Edge cases: null and empty texts are one end token; without training texts
every token is unknown and the model is uniform; repeated rows are scored one by
one; columns of the input that carry the name of a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.frequent import most_frequent
from stratocast.llm.names import renamed, set_apart
from stratocast.storage import stored

SHORT = 512
MANY = 1 << 18
CONTEXT = 3
DIM = 16
NOISE = 64
NOISE_WITHIN = 4  # for each token, from its own group
TAIL = 256
ROUNDS = 4
COPY = 1 << 23  # tokens that a copy of the model learns from in a round, where there are enough
LEAST = 1 << 19  # tokens from which on a round is worth another copy
PIECE = 1 << 14  # vectors that are averaged together
BATCH = 8192
RUN = 64  # neighbouring tokens of a batch
RATE = 0.06
FLUSH = 1 << 21  # tokens whose counts a task holds
FAN = 16  # copies of the model that are averaged at a time
END = np.uint64(0x5DEECE66D5DEECE6)
SMOOTH = 0.1
LOG2_E = np.float32(np.log2(np.e))  # powers of two take half as long as of e


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after another, ends included, and where each text's begin."""
    hashes, first = W.word_hashes(texts, True)
    out = np.insert(hashes, first[1:], END)
    return out, first + np.arange(len(first))


@dataclass
class Counts:
    """Training counts of the model's frequent tokens, total, number of different tokens.

    `tail` has the log10 of the smoothed count of each class of other tokens.
    """

    counts: np.ndarray
    total: int
    kinds: int
    tail: np.ndarray


@dataclass
class Model:
    """The frequent tokens (ascending) and the vectors; outputs from len(short) on are the classes of all others.

    Outputs are ranked by frequency. The first SHORT have heads of their own;
    each `leaf` of the others in turn are a subgroup, and each `wide` subgroups a
    group, which has a head. `outputs` has the vectors of the others by rank, the
    last column of outputs, middle (subgroups) and heads is the bias.
    """

    short: np.ndarray
    share: np.ndarray
    rank: np.ndarray
    leaf: int
    wide: int
    inputs: np.ndarray
    outputs: np.ndarray
    middle: np.ndarray
    heads: np.ndarray
    places: np.ndarray
    begin: np.ndarray | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.outputs, self.middle, self.heads, self.places]

    def copy(self) -> Model:
        own = ("inputs", "outputs", "middle", "heads", "places")
        return replace(self, **{k: getattr(self, k).copy() for k in own})

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.short)
        other = n + (hashes & np.uint64(len(self.share) - n - 1)).astype(np.int64)  # the classes are a power of two
        if not n:
            return other
        top = np.uint64(64 - (2 * n).bit_length())
        if self.begin is None:  # of the tokens with the same first bits, a few at most
            self.begin = np.searchsorted(self.short >> top, np.arange((1 << 64 - int(top)) + 1, dtype=np.uint64)).astype(np.int32)
        own = (hashes >> top).astype(np.int64)
        at, end = self.begin.take(own), self.begin.take(own + 1)
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            found = self.short.take(place) == hashes[left]
            other[left[found]] = place[found]
            left = left[~found & (place + 1 < end[left])]
            at[left] += 1
        return other

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The CONTEXT ids before each token; before a text stands the id after the last class."""
        out = np.full((len(ids), CONTEXT), len(self.share), np.int64)
        at = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
        for k in range(CONTEXT):
            has = np.flatnonzero(at > k)
            out[has, k] = ids[has - k - 1]
        return out

    def vectors(self, context: np.ndarray) -> np.ndarray:
        """The weighted sum of the inputs of each context, with a last column of ones."""
        vector = np.ones((len(context), DIM + 1), np.float32)
        parts = self.inputs.take(context.ravel(), axis=0).reshape(-1, CONTEXT, DIM)
        vector[:, :DIM] = np.einsum("ikd,kd->id", parts, self.places)
        return vector

    def head(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank < SHORT, rank, SHORT + (rank - SHORT) // (self.leaf * self.wide))

    def log_probabilities(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural log probability of each output id in its context."""
        rank, order = _sorted(self.rank[ids])
        vector = self.vectors(context.take(order, axis=0))
        found = _dots(vector, self.heads.take(self.head(rank), axis=0)) - _norms(vector, self.heads, _small(vector, self.heads))
        deep = np.searchsorted(rank, SHORT)
        if deep < len(rank):
            v, r = vector[deep:], rank[deep:] - SHORT
            for level, at, width in ((self.middle, r // self.leaf, self.wide), (self.outputs, r, self.leaf)):
                small = _small(v, level)
                found[deep:] += _dots(v, level.take(at, axis=0))
                for k, a, b in _runs(at // width):
                    found[deep + a : deep + b] -= _norms(v[a:b], level[k * width : (k + 1) * width], small)
        out = np.empty(len(ids))
        out[order] = found
        return out


def _sorted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order, and where they stood; equal ones keep theirs."""
    both = np.sort((at.astype(np.int64) << 32) | np.arange(len(at)))
    return both >> 32, both & 0xFFFFFFFF


def _starts(at: np.ndarray) -> np.ndarray:
    """Where runs of equal places begin."""
    return np.concatenate([np.zeros(min(1, len(at)), np.int64), np.flatnonzero(at[1:] != at[:-1]) + 1])


def _sums(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of the rows of each run; pairs of columns are added as complex numbers, which takes half as long."""
    out, even = np.empty((len(start), rows.shape[1]), np.float32), rows.shape[1] // 2 * 2
    pairs = np.ascontiguousarray(rows[:, :even]).view(np.complex64)
    out[:, :even] = np.add.reduceat(pairs, start, axis=0).view(np.float32)
    out[:, even:] = np.add.reduceat(rows[:, even:], start, axis=0)
    return out


def _runs(at: np.ndarray):
    start = _starts(at)
    return zip(at[start].tolist(), start.tolist(), [*start[1:].tolist(), len(at)])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b).astype(np.float64)


def _small(vector: np.ndarray, outputs: np.ndarray) -> bool:
    """Whether no product of a vector and an output can leave the range of exponentials in single precision."""
    return bool(len(vector)) and float(_dots(vector, vector).max() * _dots(outputs, outputs).max()) < 70.0**2


def _norms(vector: np.ndarray, outputs: np.ndarray, small: bool) -> np.ndarray:
    """Log of the sum of the exponentials of each vector's products with all outputs."""
    norm, top = np.empty(len(vector), np.float32), 0
    turned, ones = np.ascontiguousarray(outputs.T * LOG2_E), np.ones(len(outputs), np.float32)
    for a in range(0, len(vector), 256):
        logit = vector[a : a + 256] @ turned
        if not small:
            top = logit.max(axis=1)
            logit -= top[:, None]
        norm[a : a + 256] = np.log2(np.exp2(logit, out=logit) @ ones) + top
    return norm / LOG2_E


def initial(short: np.ndarray, share: np.ndarray, seed: int = 11) -> Model:
    """The model of the counts alone; `share` has the classes of other tokens after those of `short`."""
    rng = np.random.default_rng(seed)
    n = len(share)
    order = np.argsort(-share, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rest = share[order[SHORT:]]
    leaf = max(1, int(np.ceil(np.sqrt(len(rest)) / 2)))
    sub = np.add.reduceat(rest, np.arange(0, len(rest), leaf)) if len(rest) else rest
    wide = max(1, int(np.ceil(np.sqrt(len(sub)))))
    groups = np.add.reduceat(sub, np.arange(0, len(sub), wide)) if len(sub) else sub
    mass = np.append(share[order[:SHORT]], groups)
    bias = lambda x: np.column_stack([rng.normal(0, 0.01, (len(x), DIM)), np.log(x)]).astype(np.float32)
    return Model(
        short,
        share,
        rank,
        leaf,
        wide,
        rng.normal(0, 0.1, (n + 1, DIM)).astype(np.float32),
        bias(rest / np.repeat(sub, leaf)[: len(rest)]),
        bias(sub / np.repeat(groups, wide)[: len(sub)]),
        bias(mass),
        (np.ones((CONTEXT, DIM)) / (1 + np.arange(CONTEXT))[:, None]).astype(np.float32),
    )


def _odds(logit: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(logit)), in place of the logit."""
    with np.errstate(over="ignore"):  # 1 / infinity is 0
        for a in range(0, len(logit), 1024):  # what a processor's cache holds
            x = logit[a : a + 1024]
            x *= LOG2_E
            np.exp2(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
    return logit


class Trainer:
    """Steps with Adagrad on all levels.

    Subgroups learn from the whole softmax of their group, the other levels by
    noise-contrastive estimation: a batch shares the noise of the heads, and
    within it the tokens of a subgroup share theirs.
    """

    def __init__(self, model: Model, seed: int, rate: float = RATE):
        self.m = model.copy()
        self.rate = np.float32(rate)
        self.rng = np.random.default_rng(seed)
        self.sums = [np.full(p.shape, 1e-6, np.float32) for p in self.m.parts()]
        self.times = [np.zeros(len(p), np.int64) for p in self.m.parts()]
        mass = np.bincount(model.head(model.rank), model.share, len(model.heads))
        self.log_noise = np.log(NOISE * mass).astype(np.float32)
        self.cut = np.cumsum(mass)
        self.seen = 0

    def step(self, part: int, at: np.ndarray, rows: np.ndarray, n: int, times: np.ndarray) -> None:
        """One step of the vectors at the (repeated) places, by the sum of their gradients over n tokens."""
        if (at[1:] <= at[:-1]).any():
            at, order = _sorted(at)
            start = _starts(at)
            at, rows, times = at[start], _sums(rows.take(order, axis=0), start), np.add.reduceat(times[order], start)
        g = rows / np.float32(n)
        vectors, sums = self.m.parts()[part], self.sums[part]
        s = sums.take(at, axis=0)
        s += g * g
        sums[at] = s
        g *= self.rate
        g /= np.sqrt(s, out=s)
        vectors[at] = np.subtract(vectors.take(at, axis=0), g, out=g)
        self.times[part][at] += times

    def batch(self, ids: np.ndarray, context: np.ndarray) -> None:
        seen = np.column_stack([context[:, ::-1], ids])
        self.tokens(seen.ravel(), np.arange(CONTEXT, seen.size, CONTEXT + 1))

    def tokens(self, seen: np.ndarray, at: np.ndarray) -> None:
        """A step by the tokens at the places; the CONTEXT ids before each are its context."""
        m, n = self.m, len(at)
        rank, order = _sorted(m.rank[seen[at]])
        at = at[order]
        inputs = m.inputs.take(seen, axis=0)
        rows = np.zeros_like(inputs)
        for k, weight in enumerate(m.places):
            rows[k + 1 :] += inputs[: -k - 1] * weight
        vector = np.ones((n, DIM + 1), np.float32)
        vector[:, :DIM] = rows.take(at, axis=0)
        noise = np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE)), len(self.cut) - 1)
        head = m.head(rank)
        o_own, o_noise = m.heads.take(head, axis=0), m.heads[noise]
        up = _odds(np.einsum("ij,ij->i", vector, o_own) - self.log_noise[head])[:, None]
        turned = -o_noise.T
        turned[DIM] += self.log_noise[noise]
        down = _odds(vector @ turned)
        back = down @ o_noise
        back -= up * o_own
        start = _starts(head)
        rows = np.concatenate([_sums(-up * vector, start), down.T @ vector])
        times = np.concatenate([np.diff(np.append(start, n)), np.ones(NOISE, np.int64)])
        deep = np.searchsorted(rank, SHORT)
        if deep < n:
            self.subgroups(rank[deep:] - SHORT, vector[deep:], back[deep:], n)
            self.within(rank[deep:] - SHORT, vector[deep:], back[deep:], n)
        self.step(3, np.concatenate([head[start], noise]), rows, n, times)
        pull, own = np.zeros_like(inputs), np.zeros(len(seen), np.int64)
        pull[at], own[at] = back[:, :DIM], 1
        rows, times, places = np.zeros_like(inputs), np.zeros(len(seen), np.int64), np.empty_like(m.places)
        for k, weight in enumerate(m.places):
            rows[: -k - 1] += pull[k + 1 :] * weight
            times[: -k - 1] += own[k + 1 :]
            places[k] = np.einsum("id,id->d", pull[k + 1 :], inputs[: -k - 1])
        self.step(0, seen, rows, n, times)
        self.step(4, np.arange(CONTEXT), places, n, np.ones(CONTEXT, np.int64))
        self.seen += n

    def subgroups(self, rank: np.ndarray, v: np.ndarray, back: np.ndarray, n: int) -> None:
        """A step of the subgroups of the (ascending) ranks; adds to `back` the gradient of v."""
        m, sub = self.m, rank // self.m.leaf
        start = _starts(sub)
        rows, times = np.zeros_like(m.middle), np.zeros(len(m.middle), np.int64)
        back -= m.middle.take(sub, axis=0)
        small, scaled = _small(v, m.middle), m.middle * LOG2_E
        for g, a, b in _runs(sub // m.wide):
            of = slice(g * m.wide, (g + 1) * m.wide)
            p = v[a:b] @ scaled[of].T
            if not small:
                p -= p.max(axis=1, keepdims=True)
            np.exp2(p, out=p)
            p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
            back[a:b] += p @ m.middle[of]
            rows[of] = p.T @ v[a:b]
            times[of] = b - a
        rows[sub[start]] -= _sums(v, start)
        at = np.flatnonzero(times)
        self.step(2, at, rows[at], n, times[at])

    def within(self, rank: np.ndarray, v: np.ndarray, back: np.ndarray, n: int) -> None:
        """Steps of the outputs of the (ascending) ranks and of the noise; adds to `back` the gradient of v."""
        m, sub = self.m, rank // self.m.leaf
        start, own = _starts(sub), _starts(rank)
        count = np.diff(np.append(start, len(sub)))
        size = np.minimum(m.leaf, len(m.outputs) - sub[start] * m.leaf)[:, None]
        place = (self.rng.random(size.shape) * size).astype(np.int64) + size * np.arange(NOISE_WITHIN) // NOISE_WITHIN
        drawn = sub[start][:, None] * m.leaf + np.sort(place % size, axis=1)
        of = np.repeat(np.arange(len(start)), count)
        log_noise = np.log(NOISE_WITHIN / size).astype(np.float32)[of]
        o_own = m.outputs.take(rank, axis=0)
        o_drawn = m.outputs.take(drawn.ravel(), axis=0).reshape(*drawn.shape, -1).take(of, axis=0)
        up = _odds(np.einsum("ij,ij->i", v, o_own)[:, None] - log_noise)
        down = _odds(log_noise - np.einsum("ij,ikj->ik", v, o_drawn))
        back += np.einsum("ik,ikj->ij", down, o_drawn)
        back -= up * o_own
        pushed = _sums((down[:, :, None] * v[:, None]).reshape(len(v), -1), start).reshape(-1, DIM + 1)
        self.step(1, rank[own], _sums(-up * v, own), n, np.diff(np.append(own, len(rank))))
        self.step(1, drawn.ravel(), pushed, n, np.repeat(count, NOISE_WITHIN))

    def learn(self, texts: list) -> None:
        """Batches of runs of tokens from all over a slice, so that neighbours share the vectors of their contexts."""
        before = len(self.m.share)
        for a, b in W.slices(texts):
            hashes, first = tokens(texts[a:b])
            runs = -(-(len(hashes) + CONTEXT * (b - a)) // RUN)
            ids = np.full(runs * RUN + CONTEXT, before, np.int64)
            ids[np.arange(len(hashes)) + CONTEXT * np.repeat(np.arange(1, b - a + 1), np.diff(first))] = self.m.ids(hashes)
            order = self.rng.permutation(runs) * RUN
            for i in range(0, runs, BATCH // RUN):
                begin = order[i : i + BATCH // RUN, None]
                seen = ids[begin + np.arange(RUN + CONTEXT)]
                at = np.arange(seen.size).reshape(seen.shape)[:, CONTEXT:].ravel()
                seen = seen.ravel()
                at = at[seen[at] != before]
                if len(at):
                    self.tokens(seen, at)


def _counted(batches):
    held, size = [], 0

    def flush():
        name, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), pa.array(count)], ["token", "n"])

    for batch in batches:
        texts = batch.column("_bytes").to_pylist()
        for a, b in W.slices(texts):
            held.append(tokens(texts[a:b])[0])
            size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


AVERAGED = "group int, piece int, at binary, times binary, change binary"
SCALE = 256  # of changes in half precision


def _packed(group: int, piece: int, at: np.ndarray, times: np.ndarray, change: np.ndarray, maker):
    held = (at.astype(np.int32), times.astype(np.float32), np.clip(change * SCALE, -65504, 65504).astype(np.float16))
    arrays = [pa.array([group], pa.int32()), pa.array([piece], pa.int32()), *[pa.array([x.tobytes()]) for x in held]]
    return maker(arrays, ["group", "piece", "at", "times", "change"])


def _unpacked(at: bytes, times: bytes, change: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(change, np.float16).astype(np.float32).reshape(-1, DIM + 1) / SCALE
    return np.frombuffer(at, np.int32), np.frombuffer(times, np.float32), rows


def _pieces(group: int, at: np.ndarray, times: np.ndarray, rows: np.ndarray, maker):
    for piece in np.unique(at // PIECE).tolist():
        a, b = np.searchsorted(at, (piece * PIECE, (piece + 1) * PIECE))
        yield _packed(group, piece, at[a:b], times[a:b], rows[a:b], maker)


def _trained(batches, model: Model, round_: int, groups: int):
    """The changes of one copy of the model, and how often each vector was changed."""
    part = TaskContext.get().partitionId()
    trainer = Trainer(model, 1 + part + (round_ << 32), RATE / np.sqrt(1 + round_))
    for batch in batches:
        trainer.learn(batch.column("_bytes").to_pylist())
    first = 0
    for old, new, times in zip(model.parts(), trainer.m.parts(), trainer.times):
        at = np.flatnonzero(times)
        rows = np.zeros((len(at), DIM + 1))
        rows[:, : old.shape[1]] = new[at] - old[at]
        if len(at):
            yield from _pieces(part % groups, first + at, times[at], rows, pa.RecordBatch.from_arrays)
        first += len(old)


def _summed(group: pa.Table) -> pa.Table:
    piece = group.column("piece")[0].as_py()
    times, rows = np.zeros(PIECE), np.zeros((PIECE, DIM + 1))
    for x in zip(*[group.column(c).to_pylist() for c in ("at", "times", "change")]):
        at, n, change = _unpacked(*x)
        times[at - piece * PIECE] += n  # each once
        rows[at - piece * PIECE] += change * n[:, None]
    at = np.flatnonzero(times)
    return _packed(group.column("group")[0].as_py(), piece, at + piece * PIECE, times[at], rows[at] / times[at, None], pa.Table.from_arrays)


class LanguageModel:
    """Counts and model of the training texts."""

    def __init__(self, texts: DataFrame, text: str = "text"):
        spark = texts.sparkSession
        self.context = spark.sparkContext
        read = texts.select(F.col(text).cast("binary").alias("_bytes"))
        self.table = stored(read.mapInArrow(_counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("c")))
        all_ = self.table.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).first()
        end = int(END.astype(np.int64))
        often = most_frequent(self.table.where(F.col("token") != end), "c", MANY - 1)
        many = often.union(self.table.where(F.col("token") == end)).toPandas()
        names, counts = many["token"].to_numpy(np.int64).view(np.uint64), many["c"].to_numpy(np.int64)
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        total, kinds = int(all_["total"] or 0), int(all_["kinds"])
        classes = 1 << max(0, min(MANY, -(-(kinds - len(names)) // TAIL)) - 1).bit_length()
        n, k = np.zeros(classes), np.zeros(classes)
        by = self.table.groupBy(F.col("token").bitwiseAND(F.lit(classes - 1)).alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
        for r in by.toLocalIterator():  # MANY rows at most
            n[r["class"]], k[r["class"]] = r["n"], r["k"]
        known = (names & np.uint64(classes - 1)).astype(np.int64)
        tail = n - np.bincount(known, counts, classes) + SMOOTH * (k - np.bincount(known, minlength=classes) + 1)
        self.counts = Counts(counts, total, kinds, np.log10(tail))
        share = np.append(counts + SMOOTH, tail)
        self.model = self._train(read, initial(names, share / share.sum()))

    def _train(self, read: DataFrame, model: Model) -> Model:
        tokens_ = self.counts.total // ROUNDS
        copies = max(1, min(self.context.defaultParallelism, tokens_ // LEAST), -(-tokens_ // COPY))
        for i in range(ROUNDS):
            start = self.context.broadcast(model)  # of a fixed size
            groups = -(-copies // FAN)
            rows = (
                read.where(F.pmod(F.xxhash64("_bytes"), F.lit(ROUNDS)) == i)
                .coalesce(copies)
                .mapInArrow(lambda b, start=start, i=i, groups=groups: _trained(b, start.value, i, groups), AVERAGED)
                .groupBy("group", "piece")
                .applyInArrow(_summed, AVERAGED)
            )
            while groups > 1:
                groups = -(-groups // FAN)
                rows = rows.withColumn("group", F.pmod("group", F.lit(groups))).groupBy("group", "piece").applyInArrow(_summed, AVERAGED)
            model = model.copy()
            first = np.cumsum([0, *[len(p) for p in model.parts()]])
            for r in rows.toLocalIterator():  # each piece once
                at, _, change = _unpacked(bytes(r["at"]), bytes(r["times"]), bytes(r["change"]))
                for p, a, b in zip(model.parts(), first[:-1], first[1:]):
                    own = (at >= a) & (at < b)
                    p[at[own] - a] += change[own, : p.shape[1]]
            start.destroy()
        return model

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """All rows of `docs` but the text, with n_tokens, n_known, train_tokens, base_score, score."""
        added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
        docs, own = set_apart(docs)
        (text,) = renamed(own, text)
        kept = [c for c in docs.columns if c not in added and c != text]
        shared = self.context.broadcast((self.model, self.counts))  # of a fixed size
        told = "_text bigint, _sent bigint, n_tokens bigint, _known bigint, _often double, _class double, _rare array<bigint>, _times array<bigint>"
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
        part = stored(
            docs.select(*kept, F.col(text).cast("binary").alias("_bytes")).mapInArrow(
                lambda b: _scored(b, kept, *shared.value), f"{schema}, {told}" if kept else told
            )
        )
        rare = part.where("_sent = 1").select("_text", F.explode(F.arrays_zip("_rare", "_times")).alias("x"))
        rare = rare.select("_text", F.col("x._rare").alias("token"), F.col("x._times").alias("times"))
        found = rare.join(self.table, "token", "left").select(
            "_text", "times", F.coalesce("c", F.lit(0)).alias("c")
        )
        sums = found.groupBy("_text").agg(
            F.sum(F.col("times") * F.log10(F.col("c") + SMOOTH)).alias("_log"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_more"),
        )
        times = part.where("_sent = 1").groupBy("_text").agg(F.count(F.lit(1)).alias("_copies"))
        looked = stored(times.join(sums, "_text", "left"))  # equal texts of several tasks were sent by each
        log = F.coalesce(F.col("_log") / F.col("_copies"), F.lit(0.0))
        more = F.coalesce((F.col("_more") / F.col("_copies")).cast("bigint"), F.lit(0))
        all_log = F.col("_often") + log
        smooth = lambda n, kinds: float(np.log10(n + SMOOTH * (kinds + 1)))
        base = all_log - F.col("n_tokens") * smooth(self.counts.total, self.counts.kinds)
        return part.join(looked, "_text").select(
            *kept,
            "n_tokens",
            (F.col("_known") + more).alias("n_known"),
            F.lit(self.counts.total).cast("bigint").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("_class") + log).alias("score"),
        ).withColumnsRenamed(own)


def _scored(batches, kept: list[str], model: Model, counts: Counts):
    seen: set = set()
    logs = np.append(np.log10(counts.counts + SMOOTH), 0.0)
    names = ["_text", "_sent", "n_tokens", "_known", "_often", "_class", "_rare", "_times"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        texts = batch.column("_bytes").to_pylist()
        for a, b in W.slices(texts):
            hashes, first = tokens(texts[a:b])
            size = np.diff(first)
            text_of = np.repeat(np.arange(b - a), size)
            at = np.arange(len(hashes)) - np.repeat(first[:-1], size)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mixed(hashes + W.mixed(at.astype(np.uint64))))])
            whole = W.mixed(run[first[1:]] - run[first[:-1]] + size.astype(np.uint64)).astype(np.int64)
            ids = model.ids(hashes)
            often = ids < len(model.short)
            log = logs.take(np.where(often, ids, len(model.short)))
            p = model.log_probabilities(ids, model.contexts(ids, first)) / np.log(10)
            p = p - np.where(often, 0.0, counts.tail[np.maximum(ids - len(model.short), 0)])
            sums = lambda x: np.bincount(text_of, x, b - a)
            fresh = np.array([w not in seen and not seen.add(w) for w in whole.tolist()], bool)
            rare = np.flatnonzero(~often & fresh[text_of])
            order = rare[np.lexsort((hashes[rare], text_of[rare]))]
            r_hash, r_text = hashes[order], text_of[order]
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (r_hash[1:] != r_hash[:-1]) | (r_text[1:] != r_text[:-1])]))
            times = np.diff(np.append(start, len(order)))
            cut = np.searchsorted(r_text[start], np.arange(b - a + 1))
            columns = [
                whole, fresh.astype(np.int64), size, sums(often).astype(np.int64), sums(log), sums(p),
            ]
            for o, c in zip(out, columns):
                o.append(c)
            list_of = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))
            out[-2].append(list_of(r_hash[start].astype(np.int64)))
            out[-1].append(list_of(times))
        if texts:
            arrays = [pa.array(np.concatenate(o)) for o in out[:-2]] + [pa.concat_arrays(o) for o in out[-2:]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], [*kept, *names])
