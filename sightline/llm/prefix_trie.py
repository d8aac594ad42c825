"""Operator 12: the trie of conversation prefixes, from polynomial rolling fingerprints.

1. Turns are sorted by ranges of (conv_id, turn, role, text), so that a very long conversation spans several tasks. A numpy scan of each range
   gives a turn's place and the fingerprint of its conversation up to it: the sum of g(turn) * B^place in two 64-bit rings. What a range has to
   add, because its first conversation began in ranges before, follows from one row for each range.
2. Turns are told apart by 128-bit hashes of role and text. They are verified by their texts: equal texts are counted together, so the
   rows of one hash are compared with each other, and texts that collide get a number of their own.
3. Rebuilt conversations take their fingerprints from those of the parts: a suffix moves by a power of B. Candidates of one (depth, fingerprint)
   are verified against their representative, the smallest conv_id, in the turn and in the fingerprint of the prefix before it. By
   induction on depth a group that holds one such pair is one sequence of turns. Others are split: all but the representative's members get another
   summand from that depth on, and the check is done anew until nothing collides.
4. The nodes whose representative is c are the end of c's own path, so each path is summed from its end once, and one aggregate over all
   paths gives every node the leaves and savings of its subtree: the rollup to parents needs no round for each level.
5. The digest of the conversations that end at a node runs over sorted runs of ids, which other tasks have put together as text.

Cases: rows without a conv_id belong to no conversation and are left out; a null role or text counts as empty; a null turn comes first and
rows of one turn go by role and text; repeated rows are repeated turns; a conversation that is rebuilt from nothing ends at the root; an
empty table has no root; further columns are ignored. A very long text is in the memory of one task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import U64, arrow_rows, as_signed, mix, read_table, written

#: The query's rebuilding: a conversation takes up to HEADS - 1 turns from the first of its PERIOD.
HEADS, PERIOD = 9, 5
BASES = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
INVERSES = tuple(U64(pow(int(b), -1, 1 << 64)) for b in BASES)
RUN_IDS = 1 << 14
PREFIX_BYTES = 64


def _tasks(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def power(base: np.uint64, exponents: np.ndarray, inverse: np.uint64) -> np.ndarray:
    """base^e modulo 2^64 for each e, by squaring; negative exponents take the inverse."""
    out, left = np.ones(len(exponents), U64), np.abs(exponents).astype(U64)
    square = np.where(exponents < 0, inverse, base)
    while left.any():
        out = np.where(left & U64(1), out * square, out)
        square, left = square * square, left >> U64(1)
    return out


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).astype(np.int64).view(U64)


def turn_value(batch: pa.RecordBatch, ring: int) -> np.ndarray:
    """g: a 64-bit number of a turn's identity (t1, t2, t3)."""
    t1, t2, t3 = (unsigned(batch, c) for c in ("t1", "t2", "t3"))
    return mix(mix(t1 + U64(ring + 1)) ^ mix(t2 + t3 * BASES[0] + U64(ring + 11)))


def group_scan(groups: np.ndarray, values: list[np.ndarray], carry: dict) -> list[np.ndarray]:
    """Running sums of values (uint64) within runs of equal groups; carry holds the last group and its sums, and is moved on."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    out = []
    for k, v in enumerate(values):
        total = np.cumsum(v)
        own = total - np.repeat(total[first] - v[first], np.diff(np.append(first, len(groups))))
        if carry and carry["group"] == groups[0]:
            own[: first[1] if len(first) > 1 else None] += carry["sums"][k]
        out.append(own)
    carry["group"], carry["sums"] = int(groups[-1]), [o[-1] for o in out]
    return out


def carries(summary: list, bases: tuple) -> dict[int, tuple[int, int, list[int]]]:
    """{range: (its first group, how many rows of it and which sums the ranges before hold)} from one row (part, first, last, s: count and sums of
    the last group) for each range; where several ranges are of one group alone, they pile up."""
    out, group, skip, sums = {}, None, 0, []
    for r in sorted(summary, key=lambda r: r.part):
        n, own = r.s[0], [x % (1 << 64) for x in r.s[1:]]
        if group is not None and r.first == group:
            out[r.part] = (group, skip, sums)
            if r.last == group:
                own = [(a + b * pow(int(base), skip, 1 << 64)) % (1 << 64) for a, b, base in zip(sums, own, bases, strict=True)]
                n += skip
        group, skip, sums = r.last, n, own
    return out


def scanned(ranged: DataFrame, fields: str, values: Callable[[pa.RecordBatch, int], np.ndarray], bases: tuple) -> DataFrame:
    """fields (conv_id first), place and s0, s1, ... of ranged, which is sorted by conv_id in ranges: place counts the rows of a conversation from 0, and sk is the
    sum of values(batch, k) * bases[k]^place up to it modulo 2^64 (base 1: plain sums)."""
    kept, sums = [f.split()[0] for f in fields.split(", ")], [f"s{k}" for k in range(len(bases))]
    schema = ", ".join([fields, "place long", *(f"{x} long" for x in sums)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, state = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = column(batch, "conv_id")
            place = group_scan(groups, [np.ones(len(groups), U64)], count)[0].astype(np.int64) - 1
            own = group_scan(groups, [values(batch, k) * power(b, place, b) for k, b in enumerate(bases)], state)
            yield arrow_rows(**{c: batch.column(c) for c in kept}, place=place, **{x: as_signed(y) for x, y in zip(sums, own, strict=True)}, part=np.full(len(groups), part))

    local = written(ranged.mapInArrow(scan, schema + ", part long"), "scan")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by(F.struct(F.col("place") + 1, *sums), F.struct("conv_id", "place")).alias("s"))
    before = carries(ends.collect(), bases)  # one row for each range

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, part, place = column(batch, "conv_id"), column(batch, "part"), column(batch, "place").copy()
            own = [unsigned(batch, x).copy() for x in sums]
            for p in np.unique(part).tolist():
                if p in before:
                    group, skip, held = before[p]
                    at = np.flatnonzero((part == p) & (groups == group))
                    place[at] += skip
                    for k, b in enumerate(bases):
                        own[k][at] = U64(held[k]) + own[k][at] * U64(pow(int(b), skip, 1 << 64))
            yield arrow_rows(**{c: batch.column(c) for c in kept}, place=place, **{x: as_signed(y) for x, y in zip(sums, own, strict=True)})

    return local.mapInArrow(complete, schema) if before else local.drop("part")


def told_apart(turns: DataFrame, bits: int = 64) -> DataFrame:
    """turns (conv_id, turn, role, text) with (t1, t2, t3): equal for equal role and text, and different for different ones. bits: of each hash (fewer only in tests)."""
    cut = lambda h: F.shiftrightunsigned(h, 64 - bits) if bits < 64 else h
    hashed = turns.withColumns({"t1": cut(F.xxhash64("role", "text")), "t2": cut(F.xxhash64(F.lit("turn"), "text", "role"))})
    texts = hashed.groupBy("t1", "t2", "role", "text").agg(F.count("*").alias("n"))
    several = written(texts.groupBy("t1", "t2").agg(F.count("*").alias("k")).where("k > 1"), "collisions")
    if several.isEmpty():
        return hashed.withColumn("t3", nothing())
    number = F.row_number().over(Window.partitionBy("t1", "t2").orderBy("role", "text")) - 1
    fixes = written(texts.join(several, ["t1", "t2"]).select("t1", "t2", "role", "text", number.cast("long").alias("t3")), "collisions")
    return hashed.join(fixes, ["t1", "t2", "role", "text"], "left").withColumn("t3", F.coalesce("t3", nothing()))


def nothing() -> Column:
    return F.lit(0).cast("long")


TURN = "t1 long, t2 long, t3 long, size long"
PATH = f"conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, {TURN}"


def scanned_turns(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, TURN, place, s0, s1): each turn's place in its conversation, from 0, and the fingerprint of the conversation up to it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).where("conv_id is not null")
    named = told_apart(turns, bits).withColumn("size", F.octet_length("text").cast("long"))
    order = ["conv_id", "turn"]
    if turns.groupBy(*order).count().where("count > 1").isEmpty():
        ranged = named.drop("role", "text").repartitionByRange(_tasks(named), *order).sortWithinPartitions(*order)
    else:  # turns of one place go by their texts: ranges by the beginning only, so that their bounds stay small, and within a range by the whole text
        begin = named.withColumn("__text", F.substring(F.col("text").cast("binary"), 1, PREFIX_BYTES))
        ranged = begin.repartitionByRange(_tasks(named), *order, "role", "__text").sortWithinPartitions(*order, "role", "text")
    return scanned(ranged.select("conv_id", "t1", "t2", "t3", "size"), f"conv_id long, {TURN}", turn_value, BASES)


def as_paths(parts: DataFrame, conv_ids: DataFrame, bits: int = 64) -> DataFrame:
    """A row of PATH for each conversation and depth, the root's included: the fingerprint f, that of the prefix before p, the turn's identity and
    the bytes of its text. parts: rows of scanned_turns with shift (what a place moves by), o0, o1 (the fingerprint of what is cut off
    before them) and e0, e1 (that of what stands before them instead)."""
    mask = U64((1 << bits) - 1)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift = column(batch, "shift")
            depth, f, p = column(batch, "place") + shift + 1, [], []
            for k in range(2):
                now = unsigned(batch, f"e{k}") + (unsigned(batch, f"s{k}") - unsigned(batch, f"o{k}")) * power(BASES[k], shift, INVERSES[k])
                f.append(as_signed(now & mask))
                p.append(as_signed((now - turn_value(batch, k) * power(BASES[k], depth - 1, INVERSES[k])) & mask))
            yield arrow_rows(conv_id=batch.column("conv_id"), depth=depth, f1=f[0], f2=f[1], p1=p[0], p2=p[1], **{c: batch.column(c) for c in ("t1", "t2", "t3", "size")})

    root = conv_ids.select("conv_id", *(nothing().alias(f.split()[0]) for f in PATH.split(", ")[1:]))
    return written(parts.mapInArrow(moved, PATH).union(root), "paths")


def plain_paths(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """The paths of conversations as they are."""
    whole = scanned_turns(conversations, bits)
    return as_paths(whole.withColumns({x: nothing() for x in ("shift", "o0", "o1", "e0", "e1")}), whole.where("place = 0"), bits)


def rebuilt_paths(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """The paths of the query's conversations: the first h turns of the conversation c - c % PERIOD, then c's own after its first h; h is
    crc32(c) % HEADS."""
    whole = scanned_turns(conversations, bits)
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("long")
    convs = whole.where("place = 0").select("conv_id", h.alias("h"), (c - c % PERIOD).alias("source"))
    first = whole.where((F.col("place") < HEADS - 1) & (c % PERIOD == 0)).withColumnRenamed("conv_id", "source")
    head = convs.join(first, "source").where("place < h")  # a source has a few conversations and turns
    taken = head.groupBy("conv_id").agg((F.max("place") + 1).alias("m"), F.max_by(F.struct("s0", "s1"), "place").alias("e"))
    skipped = whole.where(F.col("place") == h - 1).select("conv_id", F.col("s0").alias("o0"), F.col("s1").alias("o1"))
    joints = convs.join(taken, "conv_id", "left").join(skipped, "conv_id", "left")
    joints = joints.select("conv_id", (F.coalesce("m", nothing()) - F.col("h")).alias("shift"), *(F.coalesce(x, nothing()).alias(x) for x in ("o0", "o1")), *(F.coalesce(f"e.s{k}", nothing()).alias(f"e{k}") for k in range(2)))
    # One row a conversation on this side, as a plain table: adaptive execution splits a very long conversation of the other.
    own = whole.where(F.col("place") >= h).join(written(joints, "joints"), "conv_id")
    begin = head.withColumns({x: nothing() for x in ("shift", "o0", "o1", "e0", "e1")})
    return as_paths(own.unionByName(begin.select(*own.columns)), convs, bits)


KEY = ["depth", "f1", "f2"]


def verified_nodes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes): nodes (KEY, p1, p2, conv_id, n_convs, size) after all collisions are split, and paths with the fingerprints that tell them apart."""
    same, rounds = [*KEY, "p1", "p2", "t1", "t2", "t3"], 0
    while True:
        kinds = written(paths.groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size")), "nodes")
        several = kinds.groupBy(*KEY).agg(F.count("*").alias("k"), F.min("conv_id").alias("least")).where("k > 1")
        other = written(kinds.join(several, KEY).where(F.col("conv_id") != F.col("least")).select(*same), "collisions")
        if other.isEmpty():
            return paths, kinds.drop("t1", "t2", "t3")
        rounds += 1
        added = other.withColumns({f"a{k}": F.shiftrightunsigned(F.xxhash64(F.lit(rounds), F.lit(k), *same), 24) for k in (1, 2)})
        w = Window.partitionBy("conv_id").orderBy("depth")
        to, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
        moved = {f"{x}{k}": F.col(f"{x}{k}").bitwiseXOR(F.coalesce(F.sum(f"a{k}").over(over), nothing())) for x, over in (("f", to), ("p", before)) for k in (1, 2)}
        joined = paths.join(added, same, "left")
        paths = written(joined.select(*[moved.get(c, F.col(c)).alias(c) for c in paths.columns]), "paths")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of ends (KEY, conv_id): the digest of each node's ids in ascending order, joined by commas.

    The ids are sorted by ranges of (node, id), where many tasks share a node; each writes runs of up to RUN_IDS as text. A digest is one
    pass by definition: a node's runs follow each other through one stream, of which one batch is held."""
    key = "depth long, f1 long, f2 long"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, f1, f2, ids = (column(batch, c) for c in (*KEY, "conv_id"))
            new = (depth[1:] != depth[:-1]) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
            first = np.flatnonzero(np.concatenate([[True], new]))
            size = np.diff(np.append(first, len(ids)))
            first = np.concatenate([np.arange(a, a + n, RUN_IDS) for a, n in zip(first.tolist(), size.tolist(), strict=True)])
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, first[1:])]
            yield arrow_rows(depth=depth[first], f1=f1[first], f2=f2[first], first=ids[first], ids=pa.array(texts, pa.string()))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key == now:
                    state.update(b"," + text.encode())
                else:
                    if now is not None:
                        found.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.encode())
            if found:
                yield arrow_rows(**dict(zip([*KEY, "ends_sha256"], zip(*found, strict=True), strict=True)))
        if now is not None:
            yield arrow_rows(**dict(zip([*KEY, "ends_sha256"], ([x] for x in (*now, state.hexdigest())), strict=True)))

    ranged = ends.select(*KEY, "conv_id").repartitionByRange(_tasks(ends), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    made = ranged.mapInArrow(runs, f"{key}, first long, ids string")
    return made.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(digest, f"{key}, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of paths (rows of PATH): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths, nodes = verified_nodes(paths)
    up = (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", nothing())), "nodes")
    # The nodes that a conversation represents are the end of its path, so each node's own value is met once.
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    valued = paths.select("conv_id", *KEY).join(own, ["conv_id", "depth"], "left").withColumns({x: F.coalesce(x, nothing()) for x in ("saved", "leaf")})
    ranged = valued.repartitionByRange(_tasks(paths), F.asc("conv_id"), F.desc("depth")).sortWithinPartitions(F.asc("conv_id"), F.desc("depth"))
    walked = scanned(ranged, "conv_id long, depth long, f1 long, f2 long", lambda batch, k: unsigned(batch, ("saved", "leaf")[k]), (U64(1), U64(1)))
    sums = walked.groupBy(*KEY).agg(F.sum("s0").alias("saved_tokens"), F.sum("s1").alias("n_leaves"))
    digests = ends_digests(walked.where("place = 0"))
    # Nodes of depth 1 are all children of one root; deeper ones look their parent up.
    root = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").select(F.struct(*KEY).alias("own"), *up).join(parents, KEY).select("own.*", "parent_conv_id")
    whole = nodes.join(sums, KEY).join(deep, KEY, "left").join(digests, KEY, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", F.lit(root.conv_id if root else None).cast("long")))
    return whole.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt_paths(read_table(spark, sf_dir, "conversations")))
