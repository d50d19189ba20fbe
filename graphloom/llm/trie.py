"""The prefix trie of rebuilt conversations, from fingerprints alone.

A conversation is rebuilt from the first turns of another one (its base) and its
own later turns; each distinct sequence of first turns is a node.

1. *Fingerprints.* A turn counts by the SHA-256 of its role and text. A sequence
   of turns has the fingerprint (sum of turn hash times base to the power of the
   place, power of the base), in four residues of 31 bits; sequences are combined
   by (a, p)(b, q) = (a + p b, p q), which is associative. So running values are
   taken range by range over the turns, and each range's first conversation is
   given the product of what precedes it: one row for each range. The
   fingerprint of a rebuilt prefix is the base's head times the own suffix, which
   is a quotient of two own prefixes; rebuilt texts are never made, and texts
   aren't shuffled.
2. *Nodes.* Rows (conversation, depth) meet by fingerprint. A row carries the
   digest of its last turn and the fingerprint of its parent, and in each group
   all of them have to be the same: by induction over depth all members then have
   the same turns. If a group fails, all is done anew with another base.
3. *Subtrees* without walking them. Nodes belong to their smallest member, so a
   conversation owns the deepest part of its path, and a subtree's nodes are its
   members' own parts. With E a member's bytes in all, S - b the bytes above the
   node, and A the bytes above a member's own part, the subtree holds
   sum(E) - n (S - b) bytes counted once for each member, and
   sum(E - A over members that own a part) + least A - (S - b) counted once; their
   difference is what is saved. Leaves are counted at their owners.
4. Conversations that end at a node are listed in ranges of ids, each range
   joined to pieces of bounded length, which are hashed in order.

Defined results: rows without a conversation id take no part; null role or text
is empty; turns of one place are ordered by role, then by digest; repeated turns
are turns of their own; the base of a negative id is by the remainder towards
zero. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE, filled, with_classes, written

#: Residues are of this prime.
PRIME = (1 << 31) - 1
LANES = range(4)

_RANGE, _AT, _BYTES, _SUM = (PRIVATE + x for x in ("range", "at", "bytes", "sum"))
#: A turn's fingerprint: that of the conversation up to it, and before it.
_G, _H = [f"{PRIVATE}g{k}" for k in LANES], [f"{PRIVATE}h{k}" for k in LANES]
_D = [f"{PRIVATE}d{k}" for k in LANES]

#: Most ids in a piece of a list of ends.
PIECE = 50_000


def bases(seed: int) -> list[int]:
    """One base for each residue."""
    draw = np.random.default_rng([20_240_801, seed])
    return [int(x) for x in draw.integers(1 << 20, PRIME - 1, len(LANES))]


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """base to the power of each n >= 0, modulo the prime."""
    out, square, left = np.ones(len(n), np.int64), base, n.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def inverse_power(base: int, n: Column, most: int) -> Column:
    """base to the power of -n as a column, for n from 0 to ``most``."""
    inverse = pow(base, -1, PRIME)
    return F.get(F.array(*(F.lit(pow(inverse, e, PRIME)).cast("long") for e in range(most + 1))), n.cast("int"))


def running(ids: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, at: list[int], carry: dict) -> dict:
    """Of rows in order, within each id: place from 1, sum of sizes, fingerprints
    up to each row and before it. ``carry`` holds those of the last id so far."""
    n = len(ids)
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    goes_on = carry.get("id") == int(ids[0])
    start = np.zeros(len(first), np.int64)
    place = np.arange(n) - first[run]
    if goes_on:
        start[0] = carry["at"]
        place = place + start[run]
    total = np.cumsum(sizes)
    before = (total - sizes)[first]
    summed = total - before[run] + np.where(run == 0, carry["sum"] if goes_on else 0, 0)
    up_to, ahead = [], []
    for k in LANES:
        term = hashes[k] * powers(at[k], place) % PRIME
        sums = np.cumsum(term)
        own = sums - (sums - term)[first][run] + np.where(run == 0, carry["g"][k] if goes_on else 0, 0)
        up_to.append(own % PRIME)
        ahead.append((own - term) % PRIME)
    carry.update(id=int(ids[-1]), at=int(place[-1]) + 1, sum=int(summed[-1]), g=[int(g[-1]) for g in up_to])
    return {"place": place + 1, "sum": summed, "up_to": up_to, "ahead": ahead}


def fingerprinted(conversations: DataFrame, seed: int, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """All turns with their place, bytes, digest and fingerprints within their
    conversation. Written once; a conversation may lie in any number of tasks."""
    at = bases(seed)
    role, text = filled(role_col), filled(text_col)
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.octet_length(text).cast("long").alias(_BYTES),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
    )
    order = ["conv_id", "turn", "role", "digest"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", _BYTES, "digest")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, carry = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not len(batch):
                continue
            ids, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", _BYTES))
            words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.int64).reshape(-1, 4)
            hashes = [(words[:, k] & ((1 << 62) - 1)) % (PRIME - 1) + 1 for k in LANES]
            found = running(ids, hashes, sizes, at, carry)
            columns = [np.full(len(ids), task), ids, found["place"], sizes, found["sum"], *found["up_to"], *found["ahead"], *words.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=names)

    names = [_RANGE, "conv_id", _AT, _BYTES, _SUM, *_G, *_H, *_D]
    local = written(ordered.mapInArrow(scan, ", ".join(f"{c} long" for c in names)), "trie-turns")
    # A range's last conversation: the only one that the next may go on with.
    last = local.groupBy(_RANGE).agg(F.max("conv_id").alias("conv_id"), F.min("conv_id").alias("first_id"))
    ends = local.join(F.broadcast(last), [_RANGE, "conv_id"]).groupBy(_RANGE, "conv_id", "first_id").agg(F.max(_AT).alias(_AT), F.max_by(F.struct(_SUM, *_G), _AT).alias("e"))
    # One row for each range, whatever the number of turns.
    carries, open_id, state = [], None, None
    for r in ends.orderBy(_RANGE).collect():
        goes_on = open_id == r["first_id"]
        if goes_on:
            carries.append((r[_RANGE], r["first_id"], *state[:2], *state[2], *(pow(b, state[0], PRIME) for b in at)))
        own = (r[_AT], r["e"][_SUM], [r["e"][g] for g in _G])
        if goes_on and r["conv_id"] == r["first_id"]:
            own = (state[0] + own[0], state[1] + own[1], [(g + pow(b, state[0], PRIME) * x) % PRIME for g, x, b in zip(state[2], own[2], at)])
        open_id, state = r["conv_id"], own
    more = ["c_at", "c_sum", *(f"c_g{k}" for k in LANES), *(f"c_p{k}" for k in LANES)]
    carried = conversations.sparkSession.createDataFrame(carries, ", ".join(f"{c} long" for c in [_RANGE, "conv_id", *more]))
    whole = local.join(F.broadcast(carried), [_RANGE, "conv_id"], "left")
    moved = lambda c, k: F.when(F.col("c_at").isNull(), F.col(c)).otherwise((F.col(f"c_g{k}") + F.col(f"c_p{k}") * F.col(c)) % PRIME).alias(c)
    zero = F.lit(0).cast("long")
    return whole.select(
        "conv_id", (F.col(_AT) + F.coalesce("c_at", zero)).alias(_AT), _BYTES, (F.col(_SUM) + F.coalesce("c_sum", zero)).alias(_SUM),
        *(moved(c, k) for c, k in zip(_G, LANES)), *(moved(c, k) for c, k in zip(_H, LANES)), *_D,
    )


def joined(lanes: list[Column]) -> tuple[Column, Column]:
    """Four residues as two longs."""
    two = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    return two(lanes[0], lanes[1]), two(lanes[2], lanes[3])


NODE = ["depth", "fp_a", "fp_b"]
UP = ["up_a", "up_b"]


def members(turns: DataFrame, base: Column, head: Column, seed: int, most: int = 8) -> DataFrame:
    """``(conv_id, depth, fingerprint, parent's fingerprint, last turn, its bytes,
    bytes so far, bytes and turns in all)`` of all rebuilt prefixes, the empty
    ones included. ``head`` is at most ``most``."""
    at = bases(seed)
    row = F.struct(F.col(_AT).alias("at"), F.col(_BYTES).alias("b"), F.col(_SUM).alias("s"), *(F.col(c).alias(c) for c in (*_G, *_H, *_D)))
    heads = turns.filter(F.col(_AT) <= most).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    own = turns.groupBy("conv_id").agg(
        F.max(_AT).alias("n"), F.max(_SUM).alias("total"),
        F.max(F.when(F.col(_AT) == head, F.struct(F.col(_SUM).alias("s"), *_G))).alias("cut"),
    )
    # Each base serves a bounded number of conversations: those of one quotient.
    convs = own.withColumn("base", base).join(heads.select(F.col("conv_id").alias("base"), "turns"), "base", "left")
    convs = convs.select("conv_id", head.alias("h"), "n", "total", "cut", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), head).alias("turns"))
    convs = convs.withColumn("kept", F.size("turns").cast("long")).withColumn("end", F.get("turns", F.size("turns") - 1))
    none = F.lit(0).cast("long")
    own_bytes = F.when(F.col("n") > F.col("h"), F.col("total") - F.coalesce("cut.s", none)).otherwise(none)
    convs = convs.select(
        "conv_id", "h", "n", "turns", "kept", (F.coalesce("end.s", none) + own_bytes).alias("all_bytes"), (F.col("kept") + F.greatest(F.col("n") - F.col("h"), none)).alias("all_turns"),
        (F.coalesce("end.s", none) - F.coalesce("cut.s", none)).alias("more"),
        *(F.coalesce(f"end.{g}", none).alias(f"b_{g}") for g in _G), *(F.coalesce(f"cut.{g}", none).alias(f"c_{g}") for g in _G),
        *(inverse_power(b, F.col("h") - F.col("kept"), most).alias(f"p_{g}") for g, b in zip(_G, at)),
    )
    convs = written(convs, "trie-conversations")

    def rows(df: DataFrame, depth: Column, up_to: list[Column], ahead: list[Column], digest: list[Column], size: Column, so_far: Column) -> DataFrame:
        (a, b), (ua, ub) = joined(up_to), joined(ahead)
        return df.select(
            "conv_id", depth.cast("long").alias("depth"), a.alias("fp_a"), b.alias("fp_b"), ua.alias("up_a"), ub.alias("up_b"),
            *(d.alias(n) for d, n in zip(digest, _D)), size.alias("b"), so_far.alias("s"), "all_bytes", "all_turns",
        )

    zeros = [none] * len(LANES)
    top = rows(convs, none, zeros, zeros, zeros, none, none)
    led = convs.select("conv_id", "all_bytes", "all_turns", F.explode("turns").alias("t"))
    field = lambda names: [F.col(f"t.{c}") for c in names]
    led = rows(led, F.col("t.at"), field(_G), field(_H), field(_D), F.col("t.b"), F.col("t.s"))
    told = convs.filter("n > h").select("conv_id", F.col("n").alias("size"), "h", "kept", "all_bytes", "all_turns", "more", *(f"{x}_{g}" for x in "bcp" for g in _G))
    # Every turn has its conversation; a conversation may have most of the turns.
    own = with_classes(turns, told, ["conv_id"], "size").filter(F.col(_AT) > F.col("h"))
    put = lambda names: [F.pmod(F.col(f"b_{g}") + F.col(f"p_{g}") * F.pmod(F.col(c) - F.col(f"c_{g}"), F.lit(PRIME)), F.lit(PRIME)) for c, g in zip(names, _G)]
    own = rows(own, F.col(_AT) - F.col("h") + F.col("kept"), put(_G), put(_H), [F.col(d) for d in _D], F.col(_BYTES), F.col(_SUM) + F.col("more"))
    return written(top.unionByName(led).unionByName(own), "trie-members")


def nodes_of(rows: DataFrame) -> DataFrame:
    """Members by node; ``same`` tells whether all have the same last turn and parent."""
    told = [*UP, *_D]
    found = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("all_bytes").alias("e"), F.min("b").alias("b"), F.min("s").alias("s"),
        *(F.min(c).alias(c) for c in told), *(F.max(c).alias(f"max_{c}") for c in told),
    )
    same = F.lit(True)
    for c in told:
        same = same & (F.col(c) == F.col(f"max_{c}"))
    return found.select(*NODE, "conv_id", "n_convs", "e", "b", "s", *UP, same.alias("same"))


def ends_hashed(rows: DataFrame) -> DataFrame:
    """For each node at which conversations end, the SHA-256 of their ids in
    order, joined by commas."""
    ends = rows.filter("depth = all_turns").select(*NODE, "conv_id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "conv_id"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NODE, "first", "ids"]
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NODE])
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]
            cuts = np.flatnonzero(new)
            cuts = np.concatenate([np.arange(a, z, PIECE) for a, z in zip(cuts, np.r_[cuts[1:], len(ids)])])
            text = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(cuts, np.r_[cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts], pa.int64()) for k in key), pa.array(ids[cuts], pa.int64()), pa.array(text)], names=names)

    pieces = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(listed, "depth long, fp_a long, fp_b long, first long, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if node != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield made(out)
        if key is not None:
            yield made([(*key, sha.hexdigest())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, fp_a long, fp_b long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, base: Column, head: Column, most: int = 8,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: a row for each node. ``base`` and ``head`` (at
    most ``most``) are a conversation's base and number of its turns that come
    from there, by ``conv_id``."""
    for seed in range(8):
        turns = fingerprinted(conversations, seed, id_col, turn_col, role_col, text_col)
        rows = members(turns, base, head, seed, most)
        nodes = written(nodes_of(rows), "trie-nodes")
        if nodes.filter("not same").isEmpty():
            break
    else:
        raise ValueError("fingerprints of different turns met with each of eight bases")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("fp_a"), F.col("up_b").alias("fp_b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "trie-counted")
    # The part of its path that a conversation owns: bytes above it, and whether its end is a leaf.
    owners = nodes.groupBy("conv_id").agg(
        F.min_by(F.col("s") - F.col("b"), "depth").alias("above"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf"), F.count(F.lit(1)).alias("size")
    )
    owners = written(owners, "trie-owners")
    told = with_classes(rows.select("conv_id", *NODE, "all_bytes"), owners, ["conv_id"], "size")
    sums = told.groupBy(*NODE).agg(F.sum(F.when(F.col("above").isNotNull(), F.col("all_bytes") - F.col("above"))).alias("once"), F.min("above").alias("above"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp_a").alias("up_a"), F.col("fp_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    placed = with_classes(nodes.drop("n_children", "same"), parents.filter("n_children > 0").withColumnRenamed("n_children", "size"), ["depth", *UP], "size")
    placed = placed.drop("size").join(nodes.select(*NODE, "n_children"), NODE).join(sums, NODE).join(ends_hashed(rows), NODE, "left")
    above = F.col("s") - F.col("b")
    saved = F.col("e") - F.col("n_convs") * above - (F.col("once") + F.col("above") - above)
    return placed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
