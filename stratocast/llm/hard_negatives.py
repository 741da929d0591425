"""Hard negatives by angular triangle filtering.

Vectors are floored to integers after scaling, and a score is the integer inner
product with an anchor. Each vector stores its angles to reference directions.
By the triangle inequality the angle between an anchor and a vector lies between
the difference and the sum of their angles to any reference; the tightest
interval of cosines over all references, times both norms and widened for
rounding, bounds the score. Only vectors whose bounds overlap a window of wanted
scores are scored. Bounds are first taken for cells of CELL vectors next to each
other in angle, then for the vectors of the cells that are left; the most
promising cells are scored first, and what they give narrows the windows.

Anchors meet vectors in blocks: vectors are listed by their nearest reference
(for positives: by a hash of their label), lists are cut into pieces of about
ROWS vectors, anchors into blocks of about ANCHORS, and every piece meets every
block in a task, which returns at most the wanted number for each window. The
references come from a bounded sample (SAMPLE vectors of LONGEST components at
most, REFERENCES directions for each length); they decide how much is skipped,
never what is found.

Edge cases: a row with a null label, a null vector, a null or non-finite
component, or a squared length of 2**62 or more after scaling, takes no part; an
anchor is compared with vectors of its own length only; a row without an id is
no anchor unless the caller says so, and comes last among ties; a repeated row
is another row; a positive with a negative score has no negatives, since its
window is empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.storage import stored

REFERENCES = 16
SAMPLE = 1024
LONGEST = 2048  # longer vectors have no references; their norms alone bound scores
ROWS = 1 << 12  # vectors of a piece
NUMBERS = 1 << 22  # components of a piece, so long vectors come in smaller pieces
ANCHORS = 1 << 12
CELL = 64
FIRST_CELLS = 4
CHUNK = 64  # anchors whose cell bounds are worked out together
ANGLE_SLACK = 1e-6  # over the rounding of stored angles (single precision) and of arc cosines near 0
SCORE_SLACK = 1e-9  # of the product of norms
_ANY = 1 << 62


def references(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors that lie far apart: each is the sample's vector farthest in angle from those before."""
    x = sample.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    x = x[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return x
    taken = [0]
    closest = x @ x[0]
    while len(taken) < most:
        far = int(np.argmin(closest))
        if closest[far] > 1 - 1e-9:
            break
        taken.append(far)
        closest = np.maximum(closest, x @ x[far])
    return x[taken]


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(whole)
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(n, len(flat) // n if n else 0)


def _describe(batches, by_size: dict[int, np.ndarray]):
    """Add to each vector its angles to the references of its length, and the nearest one."""
    for batch in batches:
        size = batch.column("size").to_numpy()
        near = np.zeros(len(size), np.int32)
        angles: list = [[]] * len(size)
        for one in np.unique(size):
            own = by_size.get(int(one))
            if own is None or not len(own):
                continue
            at = np.flatnonzero(size == one)
            x = _matrix(batch.column("q").take(pa.array(at)), np.float64)
            norm = np.linalg.norm(x, axis=1)
            cosine = x @ own.T / np.where(norm > 0, norm, 1)[:, None]
            angle = np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)
            near[at] = angle.argmin(axis=1)
            for i, a in zip(at, angle):
                angles[i] = a
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(near), pa.array(angles, pa.list_(pa.float32()))],
            [*batch.schema.names, "near", "angles"],
        )


# Inside a task --------------------------------------------------------------------


def bounds(phi, low, high, norm, least, most):
    """Bounds of the scores between anchors and cells of vectors.

    phi: the anchors' angles (anchors x references); low, high: the smallest and
    largest angles of each cell (cells x references); norm: the anchors' norms;
    least, most: the cells' smallest and largest norms. Two arrays, anchors x cells.
    """
    closest = np.zeros((len(phi), len(low)))
    farthest = np.full((len(phi), len(low)), np.pi)
    for r in range(phi.shape[1]):
        p, lo, hi = phi[:, r][:, None], low[:, r][None, :], high[:, r][None, :]
        np.maximum(closest, np.maximum(lo - p, p - hi), out=closest)
        np.minimum(farthest, np.minimum(p + hi, 2 * np.pi - p - lo), out=farthest)
    upper = np.cos(np.maximum(closest - ANGLE_SLACK, 0))
    lower = np.cos(np.minimum(farthest + ANGLE_SLACK, np.pi))
    slack = SCORE_SLACK * norm[:, None] * most[None, :] + 1e-6
    upper = norm[:, None] * upper * np.where(upper >= 0, most, least) + slack
    lower = norm[:, None] * lower * np.where(lower >= 0, least, most) - slack
    return lower, upper


def _leading(score: np.ndarray, unnamed: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` best: larger scores, then named before unnamed, then smaller names."""
    at = np.arange(len(score))
    if len(at) > most:
        at = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    return at[np.lexsort((name[at], unnamed[at], -score[at]))][:most]


class _Rows:
    """The vectors of a piece in order of angle, with the cells' ranges of angles and norms."""

    def __init__(self, table: pa.Table, labels: np.ndarray, exact: bool):
        near, angles = table.column("near").to_numpy(), _matrix(table.column("angles"), np.float64)
        own = angles[np.arange(len(near)), near] if angles.shape[1] else np.zeros(len(near))
        order = np.lexsort((own, near))
        self.near, self.own = near[order], own[order]
        self.norm = table.column("norm").to_numpy()[order]
        self.q = _matrix(table.column("q"), np.float64 if exact else np.int64)[order]
        self.row = table.column("row").to_numpy()[order]
        key = table.column("key")
        self.unnamed = key.is_null().to_numpy()[order]
        self.name = key.fill_null(0).to_numpy()[order]
        self.label = labels[order]
        begin = np.arange(0, len(order), CELL)
        angles = angles[order]
        self.low, self.high = (f.reduceat(angles, begin, axis=0) if angles.shape[1] else np.zeros((len(begin), 0)) for f in (np.minimum, np.maximum))
        self.least, self.most = np.minimum.reduceat(self.norm, begin), np.maximum.reduceat(self.norm, begin)

    def of_cells(self, cells: np.ndarray) -> np.ndarray:
        at = (cells[:, None] * CELL + np.arange(CELL)).ravel()
        return at[at < len(self.row)]

    def narrowed(self, at: np.ndarray, phi: np.ndarray, norm: float, floor: float) -> np.ndarray:
        """Those of `at` whose angle to their own nearest reference lets the score reach `floor`."""
        if not len(phi):
            return at
        closest = np.maximum(np.abs(self.own[at] - phi[self.near[at]]) - ANGLE_SLACK, 0)
        size = norm * self.norm[at]
        return at[size * np.cos(closest) + SCORE_SLACK * size + 1e-6 >= floor]


def _search(rows: pa.Table, anchors: pa.Table, most: int, rates: tuple[int, int] | None) -> pa.Table:
    """The best `most` vectors of a piece for each anchor.

    With `rates`: those of other labels, in a window of so many percent of each of
    the anchor's `scores`. Without: those of the anchor's label, in one window.
    """
    found: dict[str, list] = {k: [] for k in ("anchor", "window", "key", "row", "score")}
    if len(rows) and len(anchors):
        labels = pa.chunked_array([*rows.column("label").chunks, *anchors.column("label").chunks]).combine_chunks()
        code = labels.dictionary_encode().indices.to_numpy()
        a_norm = anchors.column("norm").to_numpy()
        # A sum of products stays below the product of the norms, so doubles hold it whole.
        exact = a_norm.max() * rows.column("norm").to_numpy().max() < 2.0**52
        piece = _Rows(rows, code[: len(rows)], exact)
        a_label, a_row = code[len(rows) :], anchors.column("row").to_numpy()
        a_q, a_angles = _matrix(anchors.column("q"), piece.q.dtype.type), _matrix(anchors.column("angles"), np.float64)
        scores = anchors.column("scores").to_pylist()
        for begin in range(0, len(anchors), CHUNK):
            part = slice(begin, begin + CHUNK)
            lower, upper = bounds(a_angles[part], piece.low, piece.high, a_norm[part], piece.least, piece.most)
            for i in range(begin, min(begin + CHUNK, len(anchors))):
                windows = [(0, -_ANY, _ANY)] if rates is None else _windows(scores[i], *rates)
                if windows:
                    edges = lower[i - begin], upper[i - begin]
                    anchor = a_q[i], a_angles[i], a_norm[i], a_label[i], a_row[i]
                    for k, at, score in _best(piece, windows, edges, anchor, rates is None, most):
                        found["anchor"].append(np.full(len(at), a_row[i]))
                        found["window"].append(np.full(len(at), k))
                        found["key"].append(pa.array(piece.name[at], pa.int64(), mask=piece.unnamed[at]))
                        found["row"].append(piece.row[at])
                        found["score"].append(score)
    columns = {
        k: pa.chunked_array([pa.array(x, pa.int64()) for x in v], pa.int64()) if v else pa.array([], pa.int64())
        for k, v in found.items()
    }
    return pa.table(columns)


def _windows(scores: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """Number, least and largest score of the windows that are not empty."""
    edges = [(k, -(-low * s // 100), high * s // 100) for k, s in enumerate(scores)]
    return [(k, max(a, -_ANY), min(b, _ANY)) for k, a, b in edges if a <= b]


def _best(piece: _Rows, windows, edges, anchor, same: bool, most: int):
    """For each window its number, and the positions and scores of its best vectors in the piece."""
    (lower, upper), (q, phi, norm, label, row) = edges, anchor
    overlap = np.zeros(len(upper), bool)
    for _, a, b in windows:
        overlap |= (upper >= a) & (lower <= b)
    cells = np.flatnonzero(overlap)
    cells = cells[np.argsort(-upper[cells], kind="stable")]
    kept: list = [(k, a, b, np.zeros(0, np.int64), np.zeros(0, np.int64)) for k, a, b in windows]
    for some in (cells[:FIRST_CELLS], cells[FIRST_CELLS:]):
        # From here on a vector must beat the last of the best where a window has as many as are wanted.
        floors = [max(a, int(s[-1])) if len(s) == most else a for _, a, _, _, s in kept]
        reach = np.zeros(len(some), bool)
        for floor, (_, _, b, _, _) in zip(floors, kept):
            reach |= (upper[some] >= floor) & (lower[some] <= b)
        at = piece.of_cells(some[reach])
        at = at[((piece.label[at] == label) == same) & (piece.row[at] != row)]
        at = piece.narrowed(at, phi, norm, min(floors))
        if len(at):
            score = (piece.q[at] @ q).astype(np.int64)
            kept = [_merged(piece, k, a, b, held, s, at, score, most) for k, a, b, held, s in kept]
    return [(k, at, s) for k, _, _, at, s in kept if len(at)]


def _merged(piece: _Rows, k, a, b, held, held_score, at, score, most):
    inside = (score >= a) & (score <= b)
    at, score = np.concatenate([held, at[inside]]), np.concatenate([held_score, score[inside]])
    lead = _leading(score, piece.unnamed[at], piece.name[at], most)
    return k, a, b, at[lead], score[lead]


# Tables ---------------------------------------------------------------------------


def quantized(rows: DataFrame, anchor: Column, scale: int, key: str, embedding: str, label: str) -> DataFrame:
    """The rows that take part: row (a number of its own), key, label, anchor, q (integers), size, norm."""
    number = F.transform(embedding, lambda v: F.floor(scale * v.cast("double")))
    squares = F.aggregate("q", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    usable = F.col(label).isNotNull() & F.forall(embedding, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return (
        rows.where(usable)
        .select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).cast("bigint").alias("key"),
            F.col(label).alias("label"),
            F.coalesce(anchor, F.lit(False)).alias("anchor"),
            number.alias("q"),
        )
        .withColumn("_squares", squares)
        .where(F.col("_squares") < 2.0**62)
        .select(
            "row",
            "key",
            "label",
            "anchor",
            F.transform("q", lambda v: v.try_cast("int")).alias("q"),
            F.size("q").alias("size"),
            F.sqrt("_squares").alias("norm"),
        )
    )


def choose_references(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Reference directions by length, from a bounded sample."""
    n = vectors.count()
    cut = -(-(SAMPLE << 20) // max(n, 1))
    sample = vectors.where((F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < cut) & F.col("size").between(1, LONGEST))
    groups: dict[int, list] = {}
    for r in sample.select("size", "q").limit(2 * SAMPLE).collect():
        groups.setdefault(r["size"], []).append(r["q"])
    return {size: references(np.array(q, np.float64)) for size, q in groups.items()}


def _pieces(size: str = "size") -> Column:
    """Vectors of a piece for vectors of this length."""
    return F.greatest(F.lit(1), F.least(F.lit(ROWS), F.floor(NUMBERS / F.greatest(F.col(size), F.lit(1)))))


def _met(rows: DataFrame, anchors: DataFrame, most: int, rates: tuple[int, int] | None = None) -> DataFrame:
    """The best of each (list, piece) for each anchor and window. Both sides have size, list, piece and block."""
    keys = ["size", "list", "piece", "block"]
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # both sides come from one table
    return (
        # Dealt anew, or all pieces of a list would stay in the partition that a join put the list in.
        rows.repartition(*keys)
        .groupBy(*keys)
        .cogroup(anchors.repartition(*keys).groupBy(*keys))
        .applyInArrow(
            lambda r, a: _search(r, a, most, rates), "anchor bigint, window bigint, key bigint, row bigint, score bigint"
        )
    )


def _upto(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))


def _first(found: DataFrame, most: int, *by: str) -> DataFrame:
    """The best `most` rows of each group, numbered by `rank` from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, its first `negatives` rows of other labels.

    A negative's score lies between `low` and `high` percent of the positive's.
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    plain = stored(quantized(rows, anchor, scale, key, embedding, label))
    directions = rows.sparkSession.sparkContext.broadcast(choose_references(plain))  # of 2 * SAMPLE vectors at most
    schema = plain.withColumns({"near": F.lit(0), "angles": F.array(F.lit(0.0).cast("float"))}).schema
    vectors = stored(plain.mapInArrow(lambda batches: _describe(batches, directions.value), schema))
    carried = ["size", "list", "row", "key", "label", "q", "norm", "near", "angles"]
    piece = F.pmod(F.xxhash64("row"), F.col("pieces")).alias("piece")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block")
    count, told = F.count(F.lit(1)), F.count_if("anchor")

    # Positives: anchors meet the lists of their own label's hash.
    sizes = vectors.groupBy("size").agg(F.ceil(count / _pieces()).alias("lists"), F.ceil(told / ANCHORS).alias("blocks"))
    listed = vectors.join(sizes.drop("blocks"), "size").withColumn("list", F.pmod(F.xxhash64("label"), F.col("lists")))
    dealt = listed.groupBy("size", "list").agg(
        F.ceil(count / _pieces()).alias("pieces"), F.ceil(told / ANCHORS).alias("blocks")
    )
    both = listed.join(dealt.where("blocks > 0"), ["size", "list"])
    asked = both.where("anchor").select(*carried, F.array().cast("array<bigint>").alias("scores"), block, _upto("pieces").alias("piece"))
    found = _met(both.select(*carried, piece, _upto("blocks").alias("block")), asked, positives)
    named = vectors.where("anchor").select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    first = F.sort_array(F.collect_list(F.struct("rank", "key", "score")))  # `positives` at most
    partners = stored(
        _first(found, positives, "anchor").groupBy("anchor").agg(first.alias("positives")).join(named, "anchor")
    )

    # Negatives: anchors meet all lists of their length; what they look for follows from their positives.
    near = F.col("near").cast("bigint").alias("list")
    dealt = vectors.groupBy("size", near).agg(F.ceil(count / _pieces()).alias("pieces"))
    lists = dealt.groupBy("size").agg(F.collect_list(F.struct("list", "pieces")).alias("lists"))  # REFERENCES at most
    blocks = sizes.where("blocks > 0").drop("lists")
    scores = partners.select(F.col("anchor").alias("row"), F.col("positives.score").alias("scores"))
    asked = (
        vectors.join(scores, "row")
        .join(blocks.join(lists, "size"), "size")
        .withColumn("of", F.explode("lists"))
        .withColumns({"list": F.col("of.list"), "pieces": F.col("of.pieces")})
        .select(*carried, "scores", block, _upto("pieces").alias("piece"))
    )
    sides = vectors.withColumn("list", near).join(dealt, ["size", "list"]).join(blocks, "size")
    found = _met(sides.select(*carried, piece, _upto("blocks").alias("block")), asked, negatives, (low, high))
    positive = F.element_at("positives", F.col("window").cast("int") + 1)
    return (
        _first(found, negatives, "anchor", "window")
        .join(partners, "anchor")
        .select(
            "anchor_id",
            positive["key"].alias("positive_id"),
            "rank",
            F.col("key").alias("negative_id"),
            positive["score"].alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
