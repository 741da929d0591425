"""Sharding, hard negatives and spelling variants against brute force, with their edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.llm import hard_negatives, sharding, spelling

# 12 sharding ----------------------------------------------------------------------

DOCS = [
    (0, "one text"), (1, "one text"), (2, None), (3, ""), (4, "ünï " * 5000), (5, "x"), (5, "x"), (5, "y"), (None, "n"), (None, None),
    *[(i, f"text {i % 7}") for i in range(6, 400)],
]


def plain_jump(key, shards):
    at, to = 0, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_jump_equals_the_plain_loop():
    rng = random.Random(1)
    keys = np.array([rng.getrandbits(64) for _ in range(3000)] + [0, 1, 2**64 - 1], np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    counts = np.bincount(sharding.jump(keys, 24), minlength=24)
    assert counts.min() > 80 and counts.max() < 180


def test_shards(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(5)
    clashing = docs.withColumns({c: F.lit("own") for c in ("slot", "row", "at", "part", "shard", "of", "k0")})
    rows = sharding.shard(clashing, 24, carry=("row", "k0")).collect()
    assert len(rows) == len(DOCS)
    slots = collections.defaultdict(list)
    for r in rows:
        assert r["row"] == r["k0"] == "own" and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in DOCS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    again = sharding.shard(clashing.repartition(2), 24, carry=("row", "k0")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    grown = {(r["doc_id"]): r["grown_shard"] for r in rows}
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 25).collect()} == grown
    together = sharding.shard(docs.where("text is not null"), 24, key="text")
    assert together.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
    assert sharding.shard(docs.where("doc_id < -1")).count() == 0


def test_written_shards_and_moves(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), 6, pieces=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))
    assert back.where(F.col("shard") != sharding.shard_of("doc_id", 6)).isEmpty()
    moves = sharding.moved(docs, 6, 2).collect()
    assert moves and all(r["to_shard"] >= 6 for r in moves) and len(moves) < len(DOCS) / 2


# 11 hard negatives ----------------------------------------------------------------


def plain_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, vector, label); by all pairs, with whole numbers."""
    good = []
    for key, vector, label in rows:
        if label is None or vector is None or any(v is None or not np.isfinite(v) for v in vector):
            continue
        q = [int(np.floor(256 * v)) for v in vector]
        if sum(v * v for v in q) < 2**62:
            good.append((key, q, label))
    out = []
    for i, (key, q, label) in enumerate(good):
        if not anchor(key):
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, p)), k is None, k or 0, lab)
            for j, (k, p, lab) in enumerate(good)
            if j != i and len(p) == len(q)
        ]
        scored.sort(key=lambda s: s[:3])
        for s, none, k, _ in [s for s in scored if s[3] == label][:positives]:
            inside = [n for n in scored if n[3] != label and low * -s <= 100 * -n[0] <= high * -s][:negatives]
            out += [(key, None if none else k, r + 1, None if n[1] else n[2], -s, -n[0]) for r, n in enumerate(inside)]
    return collections.Counter(out)


SCHEMA = "vec_id bigint, embedding array<double>, label int"


def mined(df, **more):
    found = hard_negatives.hard_negatives(df, anchor=F.col("vec_id") % 10 == 0, **more)
    return collections.Counter(tuple(r) for r in found.collect())


def vectors(n, size, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    return [(i, (centres[i % 6] + spread * rng.normal(size=size)).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.7, 5.0])
def test_negatives_equal_all_pairs(spark, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 97)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 11)
    rows = vectors(700, 12, 3, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert mined(df) == plain_negatives(rows, lambda k: k % 10 == 0)
    assert mined(df, positives=2, negatives=3, low=0, high=200) == plain_negatives(rows, lambda k: k % 10 == 0, 2, 3, 0, 200)


def test_negative_edges(spark):
    inf = float("inf")
    rows = vectors(60, 4, 5, 0.5)
    rows += [(10, rows[10][1], rows[10][2])] * 2 + [(7, rows[10][1], 9)] * 3  # repeated rows, ties
    rows += [(None, rows[20][1], 0), (None, rows[20][1], 1), (100, None, 1), (110, [1.0, None, 0.0, 0.0], 1), (120, [inf, 0.0, 0.0, 0.0], 1)]
    rows += [(130, [1.0] * 4, None), (140, [0.0] * 4, 0), (150, [0.0] * 4, 0), (151, [0.0] * 4, 1), (160, [], 0), (161, [], 0), (162, [], 1)]
    rows += [(170, [1.0, 2.0], 0), (171, [1.0, 2.0], 0), (172, [0.5, 1.0], 1), (180, [1e9, 0.0, 1.0, 1.0], 1), (190, [1e6, 1e6, 0.0, 3e-3], 1)]
    rows += [(191, [1e6, 1e6, 1.0, 0.0], 1), (192, [6e5, 6e5, 0.0, 0.3], 0), (193, [1e6, 7e5, 0.1, 0.3], 0), (200, [-1.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clashing = df.withColumns({c: F.lit("own") for c in ("row", "key", "q", "size", "norm", "near", "angles", "anchor", "list", "piece")})
    want = plain_negatives(rows, lambda k: k is not None and k % 10 == 0)
    assert want and mined(clashing) == want
    assert mined(df.where("vec_id < -1")) == collections.Counter()


def test_score_bounds_hold():
    rng = np.random.default_rng(2)
    q = np.floor(256 * np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(3, 8)).repeat(60, 0) + 0.01 * rng.normal(size=(180, 8))]))
    own = hard_negatives.references(q)
    norm = np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip(q @ own.T / norm[:, None], -1, 1)).astype(np.float32).astype(float)
    lower, upper = hard_negatives.bounds(angles, angles, angles, norm, norm, norm)
    score = q @ q.T
    assert (lower <= score).all() and (score <= upper).all()
    assert (upper < 0.9 * norm[:, None] * norm[None, :]).mean() > 0.3  # they do say something


# 13 spelling ----------------------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, least=3):
    n = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others and n[top := min(others, key=lambda v: (-n[v], v))] >= 2 * n[w]:
            form[w] = top
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def scribble(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("aeßüÀÿ÷")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word])


def spelt(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abÄé", k=rng.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    return " ".join(scribble(rng, w) if rng.random() < 0.5 else w for w in rng.choices(base, weights=range(1, 44), k=n))


@pytest.mark.parametrize("piece", [1 << 14, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    monkeypatch.setattr(spelling, "QUERIES", 5 if piece == 7 else spelling.QUERIES)
    docs = [(i, spelt(300, i)) for i in range(12)] + [(3, spelt(300, 3))] * 2
    docs += [(None, spelt(50, 40)), (20, None), (21, ""), (22, "1 2 3"), (23, "z" * 3000 + " " + "z" * 2999), (24, "z" * 3000), (25, "z" * 3000), (26, "z" * 2999 + "." + "z" * 2999)]
    docs += [(30, "KÖNIG König könig kÖnig KELVINK İstanbul x́" * 4), (31, "snow☃snow \U0001f600")]
    docs += [(40 + i, ("bridge " * 8 + "bridgee " * 3 + "bridgeex ") * 2) for i in range(3)]  # a chain of forms
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    clashing = df.withColumns({c: F.lit("own") for c in ("id", "run", "h", "word", "n", "piece", "tail")})
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(clashing).collect()}
    want = plain_variants(docs)
    assert len([w for w in want if w[1]]) > 20 and any(w[1] != w[2] for w in want if w[1])
    assert got == want
    assert spelling.spelling_variants(df.where("doc_id < -1")).count() == 0


def test_bit_index_equals_comparison():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=rng.choice([6, 7]))) for _ in range(150)})
    for a, b in ((7, 7), (7, 6), (6, 6)):
        asked, held = [w for w in words if len(w) == a], [w for w in words if len(w) == b]
        got = set(zip(*map(np.ndarray.tolist, spelling.near(asked, held))))
        assert got == {(i, j) for i, x in enumerate(asked) for j, y in enumerate(held) if one_apart(x, y)}
    with pytest.raises(ValueError):
        spelling.near(["aaaaa"], ["aaaaaa"])
