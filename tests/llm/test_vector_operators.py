"""Hard negatives, exact top-k search and the prefix trie."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import negatives, top_k, trie
from graphloom.llm import vectors as V

NAN, INF = float("nan"), float("inf")

CLASH = "query_id rank score positive_id asks label2 depth size id v"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=6) * (1 + i % 3)], int(i % 4)) for i in range(300)]
    rows += [(i, rows[8][1], 1) for i in range(300, 400)]  # a hot vector
    rows += [(400, None, 1), (401, [None, 1.0], 1), (402, [NAN] * 6, 2), (403, [INF] * 6, 2), (None, [1.0] * 6, 2), (404, [1.0] * 6, None), (405, [], 1), (406, [0.5, 0.5], 2), (407, [0.0] * 6, 3)]
    rows += [(50, [0.1] * 6, 3), (7, rows[7][1], 3)]  # repeated ids
    names = CLASH.split()
    return spark.createDataFrame([(*r, *["q"] * len(names)) for r in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"{n} string" for n in names)).repartition(3)


def plain_rows(df, with_label):
    out = []
    for r in df.collect():
        if r.vec_id is None or r.embedding is None or any(x is None or not np.isfinite(x) for x in r.embedding) or with_label and r.label is None:
            continue
        out.append((r.vec_id, tuple(int(np.floor(256 * float(x))) for x in r.embedding), r.label))
    return out


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), V.LOWEST), V.HIGHEST)


def asking(rows, divisor):
    """Query rows, of one id the smallest."""
    return {i: v for i, *v in sorted((r for r in rows if r[0] % divisor == 0), reverse=True, key=lambda r: r)}


def plain_top(rows, divisor, k):
    out = []
    for q, (vector, _) in asking(rows, divisor).items():
        there = sorted((-dot(vector, v), i) for i, v, _ in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(there, 1)]
    return sorted(out)


def plain_negatives(rows, divisor, n_pos, n_neg, low, high):
    out = set()
    for q, (vector, label) in asking(rows, divisor).items():
        there = sorted((-dot(vector, v), i, x) for i, v, x in rows if i != q)
        for s, p in [(-s, i) for s, i, x in there if x == label][:n_pos]:
            fits = [(-t, i) for t, i, x in there if x != label and low * s <= -100 * t <= high * s][:n_neg]
            out |= {(q, p, n, i, s, t) for n, (t, i) in enumerate(fits, 1)}
    return sorted(out)


def test_top_k_of_odd_rows_equals_a_plain_search(odd_vectors):
    got = sorted(tuple(r) for r in top_k.top_k(odd_vectors, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == plain_top(plain_rows(odd_vectors, False), 10, 5)
    assert top_k.top_k(odd_vectors.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0
    few = odd_vectors.filter("vec_id in (10, 11)")
    assert [tuple(r)[:3] for r in top_k.top_k(few, F.col("vec_id") % 10 == 0, 5).collect()] == [(10, 1, 11)]


def test_hard_negatives_of_odd_rows_equal_a_plain_search(odd_vectors):
    find = lambda df: negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))
    got = sorted(tuple(r) for r in find(odd_vectors).collect())
    want = plain_negatives(plain_rows(odd_vectors, True), 10, 5, 3, 50, 95)
    assert got == want and len(got) > 100
    assert find(odd_vectors.limit(0)).count() == 0
    assert find(odd_vectors.filter("label = 1")).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e9, 5.0]), (2, [1e9, 4.0]), (3, [1e30, 1.0]), (4, [-1e30, 1.0]), (5, [1e30, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in top_k.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    e = (256 * 10**9) ** 2
    assert got == [(0, 1, 1, V.HIGHEST), (0, 2, 2, V.HIGHEST), (0, 3, 3, V.HIGHEST), (0, 4, 5, V.HIGHEST), (0, 5, 4, V.LOWEST)] and e > V.HIGHEST
    less = spark.createDataFrame([(0, [1e7, 3.0]), (1, [1e7, 5.0]), (2, [1e7, 4.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k.top_k(less, F.col("vec_id") == 0, 2).orderBy("rank").collect()]
    assert got == [(1, (256 * 10**7) ** 2 + 256**2 * 15), (2, (256 * 10**7) ** 2 + 256**2 * 12)]


def clustered(n, width=16, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, width)) * 4
    return np.floor(256 * (centres[draw.integers(0, 20, n)] + draw.normal(size=(n, width)) * 0.3))


def test_pivots_leave_few_rows_to_score():
    rows = clustered(8_000)
    table = top_k.PivotTable(np.arange(len(rows)), rows, top_k.far_apart(rows[:1000], 32))
    scored = 0
    for q in range(40):
        score, ids, n = table.search(q, rows[q], 5)
        want = V.best(np.delete((rows @ rows[q]).astype(np.int64), q), np.delete(np.arange(len(rows)), q), 5)
        assert (score == want[0]).all() and (ids == want[1]).all()
        assert (table.bounds(rows[q]) >= rows @ rows[q]).all()
        scored += n
    assert scored < 0.3 * 40 * len(rows)


def test_coordinate_lists_leave_few_rows_to_score():
    rows = clustered(8_000).astype(np.int64)
    known = V.Shape(len(rows), rows.shape[1], True)
    labels = np.arange(len(rows)) % 3
    block = negatives.Block(pa.table({V.ID: np.arange(len(rows)), V.VECTOR: list(rows), negatives._LABEL: labels}), known)
    assert len(block.buckets) > 4 and all(b.shortest >= negatives.SHORTER * b.longest - 1e-6 for b in block.buckets)
    for q in range(40):
        everything = rows @ rows[q]
        fits = (labels == labels[q]) & (np.arange(len(rows)) != q)
        want = V.best(everything[fits], np.flatnonzero(fits), 5)
        got = block.positives(q, rows[q].astype(float), labels[q], 5)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert block.scored < 0.5 * 40 * len(rows)


def test_feasible_ranges_hold_every_row_of_the_cone():
    draw = np.random.default_rng(9)
    rows = np.floor(draw.normal(size=(500, 5)) * 300)
    lengths = np.sqrt((rows**2).sum(1))
    order = np.argsort(-lengths)
    bucket = negatives.Bucket(order, rows[order], np.zeros(500, int), lengths[order])
    for q in range(60):
        query = rows[q] * draw.uniform(0.1, 3)
        length = np.sqrt((query**2).sum())
        exact = rows[order] @ query
        for least in np.quantile(exact, [0.05, 0.5, 0.9, 0.99, 1]):
            focus = np.argsort(-np.abs(query))[:4]
            found = bucket.candidates(focus, query[focus] / length, bucket.cosine(length, int(least)))
            assert found is None or set(np.flatnonzero(exact >= least)) <= set(found)


# -- Prefix trie


def plain_trie(rows):
    """The trie from rebuilt sequences."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    nodes, of = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = of[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = []
    for path in sorted(nodes, key=len, reverse=True):
        held = sorted(nodes[path])
        saved = (len(held) - 1) * len(path[-1][1].encode()) if path else 0
        leaves = 0 if path in children else 1
        below = [known[x] for x in children.get(path, [])] if path in children else []
        if not out:
            known = {}
        known[path] = (saved + sum(s for s, _ in below), leaves + sum(n for _, n in below))
        ends = ",".join(str(c) for c in held if len(of[c]) == len(path))
        out.append((held[0], len(path), min(nodes[path[:-1]]) if path else None, len(held), len(children.get(path, [])), known[path][1], known[path][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def op12(df):
    from pyspark.sql import functions as F

    c = F.col("conv_id")
    got = trie.prefix_trie(df, c - c % 5, F.crc32(c.cast("string")) % 9)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def conversations(spark, rows):
    names = CLASH.split()
    return spark.createDataFrame([(*r, *["q"] * len(names)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)


def test_trie_of_odd_rows_equals_a_plain_one(spark):
    draw = random.Random(4)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "c" * 40, "", None])) for c in range(-12, 90) if c % 7 for t in range(draw.randrange(1, 12))]
    rows += [(None, 1, "user", "x"), (100, None, None, None), (100, None, "user", "z"), (100, 3, "user", "z"), (100, 3, "user", "z"), (101, 1, "a", "bc"), (102, 1, "ab", "c")]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(3)]  # copies
    assert op12(conversations(spark, rows)) == plain_trie(rows)
    assert op12(conversations(spark, rows[:1]).limit(0)) == []


def test_trie_of_a_conversation_that_lies_in_many_ranges(spark):
    rows = [(5, t, "user", f"turn {t % 17}" * 3) for t in range(4_000)] + [(c, t, "user", f"turn {t}" * 3) for c in range(60) if c != 5 for t in range(5)]
    df = conversations(spark, rows)
    assert op12(df) == plain_trie(rows)
    turns = trie.fingerprinted(df, 0, "conv_id", "turn", "role", "text")
    at = trie.bases(0)[0]
    got = {r[1]: r for r in turns.filter("conv_id = 5").select("conv_id", trie._AT, trie._SUM, trie._G[0], trie._D[0]).collect()}
    assert sorted(got) == list(range(1, 4_001))
    total = size = 0
    for t in range(1, 4_001):
        size += len(f"turn {(t - 1) % 17}" * 3)
        total = (total + ((got[t][4] & ((1 << 62) - 1)) % (trie.PRIME - 1) + 1) * pow(at, t - 1, trie.PRIME)) % trie.PRIME
        assert (got[t][2], got[t][3]) == (size, total)


def test_other_bases_are_drawn_when_fingerprints_collide(spark, monkeypatch):
    rows = [(c, t, "user", f"{c} {t}") for c in range(10) for t in range(3)]
    tried = []
    drawn = trie.bases
    monkeypatch.setattr(trie, "bases", lambda seed: tried.append(seed) or ([1] * 4 if seed == 0 else drawn(seed)))
    monkeypatch.setattr(trie, "joined", lambda lanes, whole=trie.joined: whole([x % 2 for x in lanes]) if tried[-1] == 0 else whole(lanes))
    assert op12(conversations(spark, rows)) == plain_trie(rows) and max(tried) == 1
