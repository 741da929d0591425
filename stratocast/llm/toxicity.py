"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly in numpy.

Each word, with a blank on either side, gives its byte n-grams of 3 to 5. An
n-gram has an embedding; a window of words is the mean of its n-grams'
embeddings, and a linear softmax turns that into a probability. A document is as
toxic as its worst window, so a few words count in a long text as in a short
one, and a misspelling shares most of its n-grams with the word it comes from.
In training each document's loss reaches the embeddings of its worst window.

Edge cases: null and empty texts have no window and get the score of the bias
alone; rows without a label or a key teach nothing, and of several texts of one
labelled key the least teaches, once; without labels of both kinds every score is
0; repeated rows are scored one by one; columns of the input that carry
the name of a result column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.names import free_name
from stratocast.storage import stored

SIZES = (3, 4, 5)
BUCKET_BITS = 17
WINDOW = 4
DIM = 8
SPAN_WORDS = 1 << 17  # training works on the windows of about so many words at a time
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    """What scoring needs of embeddings and softmax: each n-gram bucket's share in the logit, and the bias."""

    logits: np.ndarray
    bias: float


def _normal(text: bytes | None) -> bytes:
    return b" " + b" ".join((text or b"").lower().split()) + b" "


def _word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at every byte."""
    size = max(0, len(data) - n + 1)
    up, down = W.powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    raw = (sums[n : n + size] - sums[:size]) * down[:size] * _SPREAD
    return (raw >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram buckets of the words one after another, and where each word's begin."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    starts, ends = _word_bounds(data)
    counts = {n: np.maximum(0, ends - starts + 3 - n) for n in SIZES}
    begin = np.concatenate([[0], np.cumsum(sum(counts.values()))])
    ids, at = np.empty(begin[-1], np.int32), begin[:-1].copy()
    for n, count in counts.items():
        buckets = _buckets(data, n).astype(np.int32)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ids[np.repeat(at, count) + place] = buckets[np.repeat(starts - 1, count) + place]
        at += count
    return ids, begin


@dataclass
class Span:
    """The words of some texts, of which `at` is the first; and each word's window: its end and number of n-grams."""

    at: int
    flat: np.ndarray
    first: np.ndarray
    until: np.ndarray
    n_window: np.ndarray


def _spans(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts that have about SPAN_WORDS words together."""
    place = (np.cumsum(lengths) - lengths) // SPAN_WORDS
    cuts = np.flatnonzero(np.diff(place)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)]))


def _windows(texts: list[np.ndarray], at: int, counts: np.ndarray) -> Span:
    flat = np.concatenate(texts)
    lengths = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(lengths)])
    # The window at each word is cut short at the end of its text.
    until = np.minimum(np.arange(len(flat)) + WINDOW, np.repeat(first[1:], lengths)).astype(np.int32)
    run = np.concatenate([[0], np.cumsum(counts[flat])])
    return Span(at, flat, first, until, np.maximum(run[until] - run[:-1], 1).astype(np.float32))


def train(texts: list[np.ndarray], labels: np.ndarray, words: list[bytes], steps: int = 120, seed: int = 7) -> Model:
    """Fit embeddings and softmax by Adam on whole passes; texts hold indexes into `words`."""
    ids, begin = _word_grams(words)
    counts = np.diff(begin)
    lengths = np.array([len(t) for t in texts])
    spans = [_windows(texts[a:b], a, counts) for a, b in _spans(lengths)]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    state = {
        "e": rng.normal(0, 0.1, (size, DIM)).astype(np.float32),
        "v": rng.normal(0, 0.1, DIM).astype(np.float32),
        "b": np.zeros(1, np.float32),
    }
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in state.items()}
    warm, rate, decay = steps // 6, 0.05, 1e-6
    cuts = np.linspace(0, len(words), 1 + max(1, len(ids) >> 18)).astype(int)  # to work on part of the n-grams at a time
    parts = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]
    for step in range(1, steps + 1):
        gram = (state["e"] @ state["v"]).astype(np.float32)
        word = np.concatenate([np.add.reduceat(gram[ids[begin[a] : begin[b]]], begin[a:b] - begin[a]) for a, b in parts])
        error, per_word = np.zeros(len(texts)), np.zeros(len(words))
        for span in spans:
            here = slice(span.at, span.at + len(span.first) - 1)
            text_of = np.repeat(np.arange(len(span.first) - 1), np.diff(span.first))
            run = np.concatenate([[0.0], np.cumsum(word[span.flat], dtype=np.float64)])
            logit = ((run[span.until] - run[:-1]) / span.n_window).astype(np.float32)
            if step <= warm:  # the mean window first, then the worst
                best = np.bincount(text_of, logit, len(span.first) - 1) / lengths[here]
            else:
                best = np.maximum.reduceat(logit, span.first[:-1])
            error[here] = (1 / (1 + np.exp(-(best + state["b"]))) - labels[here]) * weight[here]
            if step <= warm:
                back = (error[here] / lengths[here])[text_of] / span.n_window
            else:
                back = np.where(logit == best[text_of], error[here][text_of], 0.0) / span.n_window
            edge = np.bincount(span.until, back, len(span.flat) + 1)
            edge[:-1] -= back
            per_word += np.bincount(span.flat, -np.cumsum(edge)[:-1], len(words))
        per_gram = np.zeros(size)
        for a, b in parts:
            per_gram += np.bincount(ids[begin[a] : begin[b]], np.repeat(per_word[a:b], counts[a:b]), size)
        per_gram = per_gram.astype(np.float32)
        grads = {
            "e": np.outer(per_gram, state["v"]) + np.float32(decay) * state["e"],
            "v": state["e"].T @ per_gram + decay * state["v"],
            "b": np.array([error.sum()], np.float32),
        }
        for k, g in grads.items():
            m, s = moments[k]
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.001) * (g * g - s)
            state[k] -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(s / np.float32(1 - 0.999**step)) + np.float32(1e-10))
    return Model((state["e"] @ state["v"]).astype(np.float32), float(state["b"][0]))


def score_texts(texts: list, model: Model) -> np.ndarray:
    """The score of each text (bytes or None)."""
    out = np.empty(len(texts))
    for a, b in W.slices(texts):
        parts = [_normal(t) for t in texts[a:b]]
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts, ends = _word_bounds(data)
        sums, counts = np.zeros(len(starts)), np.zeros(len(starts))
        for n in SIZES:
            buckets = _buckets(data, n)
            run = np.zeros(len(buckets) + 1)
            np.cumsum(model.logits[buckets], out=run[1:])
            count = np.maximum(0, ends - starts + 3 - n)
            sums += np.where(count > 0, run[np.minimum(starts - 1 + count, len(buckets))] - run[np.minimum(starts - 1, len(buckets))], 0.0)
            counts += count
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        text_of = np.repeat(np.arange(len(parts)), np.diff(first))
        at = np.arange(len(starts))
        until = np.minimum(at + WINDOW, first[text_of + 1])
        s_run, n_run = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0.0], np.cumsum(counts)])
        logit = (s_run[until] - s_run[at]) / np.maximum(n_run[until] - n_run[at], 1.0)
        full = first[1:] > first[:-1]
        worst = np.zeros(len(parts))
        if full.any():
            worst[full] = np.maximum.reduceat(logit, first[:-1][full])
        out[a:b] = 1 / (1 + np.exp(-(worst + model.bias)))
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    text: str = "text",
    key: str = "doc_id",
    max_rows: int = 1_500,
    max_bytes: int = 200_000,
    seed: int = 0,
) -> Model | None:
    """Train on at most `max_rows` labelled documents of each kind, none longer than `max_bytes`; None without both kinds.

    They are chosen by a hash of their key, among those whose text has a word and is not too long.
    """
    plain = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    plain = plain.where((F.length("_text") <= max_bytes) & F.col("_text").cast("string").rlike(r"[^\x20\x09-\x0D]"))
    usable = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_key IS NOT NULL AND _label IN (0, 1)")
    usable = stored(usable.distinct().join(plain.select("_key").distinct(), "_key"))
    place = F.xxhash64("_key", F.lit(seed))
    picked = [usable.where(F.col("_label") == kind).orderBy(place, "_key").limit(max_rows) for kind in (0, 1)]
    sample = (
        plain.join(F.broadcast(picked[0].unionByName(picked[1])), "_key")  # 2 * max_rows rows at most
        .groupBy("_label", "_key")
        .agg(F.min("_text").alias("_text"))  # one text of a key
        .orderBy("_label", place, "_key")
    )
    index: dict[bytes, int] = {}
    texts, kinds = [], []
    for row in sample.toLocalIterator():
        ids = [index.setdefault(w, len(index)) for w in bytes(row["_text"]).lower().split()]
        if ids:
            texts.append(np.array(ids, np.int32))
            kinds.append(row["_label"])
    order = sorted(range(len(texts)), key=lambda i: (kinds[i], len(texts[i]), texts[i].tobytes()))
    if len(set(kinds)) < 2:
        return None
    return train([texts[i] for i in order], np.array([kinds[i] for i in order]), list(index))


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All rows of `docs` with score (0 to 1) and predicted (1 from `threshold` on)."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    body = free_name(docs.columns, "bytes")
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        for batch in batches:
            values = score_texts(batch.column(body).to_pylist(), shared.value)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], [*kept, "score"])

    schema = docs.select(*kept, F.lit(0.0).alias("score")).schema
    scored = docs.select(*kept, F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
