"""Near-duplicate vectors by a pivot-permutation index.

Equal vectors of a label are one node. Each label has pivots: vectors of a
bounded sample, chosen by hash and kept only if they lie apart from those chosen
before. A node is described by its NEAREST pivots in order and stands in their
inverted lists. Nodes that share SHARED or more of these pivots are compared by
cosine in double precision, in the list of the first pivot they share. A list is
cut into pieces of about PIECE nodes; every two pieces meet in one task, which
counts links and keeps a spanning set of them, so no pair is ever a row.

Only vectors of one label and one length are compared. Number of pivots: one for
PER_PIVOT nodes of a label, MAX_PIVOTS at most for a label and ALL_PIVOTS for all;
labels beyond that use the pivots of the largest label of their length.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components, or whose label is null, links with nothing; a row without an id
links like others but names no component; repeated rows count as other vectors,
and so do rows of one id with different vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratocast.llm.components import components
from stratocast.storage import stored

NEAREST = 8
SHARED = 2
PER_PIVOT = 16
LEAST_PIVOTS = 32
MAX_PIVOTS = 512
ALL_PIVOTS = 1 << 16
APART = 0.8  # cosine from which on a pivot is too close to another
PIECE = 1024


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(candidates: np.ndarray, most: int) -> np.ndarray:
    """The first `most` unit vectors that lie apart from those taken before."""
    taken = np.zeros((0, candidates.shape[1]))
    for v in candidates:
        if len(taken) == most:
            break
        if not len(taken) or (taken @ v).max() < APART:
            taken = np.vstack([taken, v])
    return taken


def choose_pivots(nodes: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots by (label, length); under (None, length) those of the largest label."""
    sizes = nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.least(F.greatest(F.ceil(F.col("_n") / PER_PIVOT), F.lit(LEAST_PIVOTS)), F.lit(MAX_PIVOTS))
    order = Window.partitionBy("label", "size").orderBy(F.xxhash64("embedding"), "node")
    ranked = nodes.select("label", "size", "node", "embedding").withColumn("_rank", F.row_number().over(order))
    first = ranked.where(F.col("_rank") <= 2 * MAX_PIVOTS).join(sizes.withColumn("_wanted", wanted), ["label", "size"])
    rows = first.where(F.col("_rank") <= 2 * F.col("_wanted")).orderBy(F.col("_n").desc(), "label", "size", "_rank")
    out: dict[tuple, np.ndarray] = {}
    groups: dict[tuple, tuple[int, list]] = {}
    for r in rows.limit(ALL_PIVOTS).toLocalIterator():
        groups.setdefault((r["label"], r["size"]), (r["_wanted"], []))[1].append(r["embedding"])
    for (label, size), (most, vectors) in groups.items():
        out[label, size] = spread(_unit(vectors), most)
        out.setdefault((None, size), out[label, size])
    return out


def _describe(batches, pivots: dict):
    for batch in batches:
        label, size = batch.column("label").to_pylist(), batch.column("size").to_pylist()
        vectors = batch.column("embedding").to_pylist()
        near: list = [None] * len(vectors)
        for group in set(zip(label, size)):
            at = [i for i in range(len(vectors)) if (label[i], size[i]) == group]
            own = pivots.get(group, pivots.get((None, group[1])))
            if own is None:
                best = np.zeros((len(at), 1), np.int64)
            else:
                best = np.argsort(-(_unit([vectors[i] for i in at]) @ own.T), axis=1, kind="stable")[:, :NEAREST]
            for i, b in zip(at, best.tolist()):
                near[i] = b
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "near"])


def _link(group: pa.Table, least: float) -> pa.Table:
    """Weighted link counts, and links that span each group of linked nodes, of the two pieces that meet here."""
    pivot, sides = group.column("pivot")[0].as_py(), group.column("sides")[0].as_py()
    node, copies, piece = (group.column(c).to_numpy() for c in ("node", "copies", "piece"))
    x = _unit(group.column("embedding").to_pylist())
    near = group.column("near").to_pylist()
    names = {p: i for i, p in enumerate(sorted({p for r in near for p in r}))}
    held = np.zeros((len(node), len(names)), np.float32)
    for i, r in enumerate(near):
        held[i, [names[p] for p in r]] = 1
    one = np.flatnonzero(piece == sides >> 20)
    two = np.flatnonzero(piece == sides % (1 << 20))
    before = names[pivot]
    shared = min(SHARED, held.shape[1])
    links = (held[one] @ held[two].T >= shared) & (held[one][:, :before] @ held[two][:, :before].T == 0)
    links &= x[one] @ x[two].T >= least
    links &= node[one][:, None] != node[two][None, :]
    count = np.zeros(len(node), np.int64)
    count[one] += links @ copies[two]
    if sides >> 20 != sides % (1 << 20):
        count[two] += links.T @ copies[one]
    root = np.arange(len(node))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ends: list[tuple[int, int]] = []
    for i, j in zip(*np.nonzero(links)):
        a, b = find(one[i]), find(two[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            ends.append((node[one[i]], node[two[j]]))
    linked = np.flatnonzero(count)
    a = np.concatenate([node[linked], np.array([e[0] for e in ends], np.int64)])
    b = pa.array([None] * len(linked) + [int(e[1]) for e in ends], pa.int64())
    n = np.concatenate([count[linked], np.zeros(len(ends), np.int64)])
    return pa.table({"a": a, "b": b, "n": n})


def near_vectors(
    vectors: DataFrame, least: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per row of `vectors`: key, n_links, component_id, kept."""
    context = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    usable = F.coalesce(
        F.col("label").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    # A node's name is its place in the written table: keys may repeat over different vectors, hashes may meet.
    grouped = rows.where(usable).groupBy("label", "embedding").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(
        grouped.select(
            "label",
            "embedding",
            "first",
            "copies",
            F.size("embedding").alias("size"),
            F.monotonically_increasing_id().alias("node"),
        )
    )
    pivots = context.broadcast(choose_pivots(nodes))  # ALL_PIVOTS vectors at most
    schema = nodes.select("label", "size", "node", "copies", "embedding", F.array(F.lit(0)).alias("near")).schema
    described = stored(
        nodes.select("label", "size", "node", "copies", "embedding").mapInArrow(lambda b: _describe(b, pivots.value), schema)
    )
    lists = described.withColumn("pivot", F.explode("near"))
    pieces = lists.groupBy("label", "size", "pivot").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    told = lists.join(pieces, ["label", "size", "pivot"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
    met = told.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).withColumn(
        "sides", F.least("piece", "_other") * (1 << 20) + F.greatest("piece", "_other")
    )
    found = stored(
        met.drop("pieces", "_other")
        .groupBy("label", "size", "pivot", "sides")
        .applyInArrow(lambda t: _link(t, least), "a bigint, b bigint, n bigint")
    )
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = stored(components(found.where("b IS NOT NULL"), "a", "b"))
    classes = nodes.join(roots, "node", "left").join(counts, "node", "left")
    named = stored(
        classes.select(
            "label",
            "embedding",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
            "first",
        )
    )
    least_key = named.groupBy("root").agg(F.min("first").alias("component_id"))
    final = stored(named.join(least_key, "root").select("label", "embedding", "n_links", "component_id"))
    good = rows.where(usable).join(final, ["label", "embedding"]).select("_key", "n_links", "component_id")
    bad = rows.where(~usable).select("_key", F.lit(0).cast("bigint").alias("n_links"), F.col("_key").alias("component_id"))
    component = F.coalesce("component_id", "_key")
    return good.unionByName(bad).select(
        F.col("_key").alias(key), "n_links", component.alias("component_id"), (F.col("_key") == component).alias("kept")
    )
