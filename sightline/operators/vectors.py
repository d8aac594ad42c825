"""Vectors in blocks: exact search, an index of cells with triangle bounds, ranks of hits by counting, k-reciprocal neighbours.

A table of vectors has vec_id, label and embedding (of one length). Blocks of queries meet blocks of the gallery as rows of an
equi-join, and a pair of blocks is one matrix product over Arrow's buffers. Similarities are cosines, rounded to 9 digits; equal ones go by vec_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.batches import gathered
from sightline.session import written

#: Queries and gallery vectors of a block, and blocks of the gallery in a cell of the flat search.
BLOCK, CELL, SPREAD = 512, 4096, 64
#: Pivots of an index at most; they and the bounds of their cells go to all tasks.
MAX_PIVOTS = 4096
PAIRS = "q long, ql int, g long, gl int, s double"


def unit_rows(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vec_id, label, unit vectors) of structs; a zero vector stays zero."""
    ids, labels = (vectors.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    m = vectors.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
    norm = np.sqrt((m * m).sum(axis=1))
    return ids, labels, m / np.where(norm > 0, norm, 1)[:, None]


def slices(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows: a part's matrix against all pivots is some 16 MB, a whole batch's of 10 000 rows more than 300."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(a @ b.T, 9) + 0.0


def allowed_pairs(qi: np.ndarray, gi: np.ndarray, apart: int | None) -> np.ndarray:
    """Pairs of different ids; with `apart` of ids that differ by that modulus."""
    return qi[:, None] % apart != gi[None, :] % apart if apart else qi[:, None] != gi[None, :]


def _vector(*more: str) -> Column:
    return F.struct("vec_id", "label", "embedding", *more).alias("v")


def _dealt(n: int, key: str = "vec_id", seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(1, n)))


def block_pairs(queries: DataFrame, gallery: DataFrame, work: Callable, schema: str, blocks: int | None = None, *more: str) -> DataFrame:
    """work(query structs, gallery structs) -> record batches, for every block of queries (with the columns `more`) and of the gallery.

    Queries go to every cell of the gallery as blocks of about BLOCK, so the join is an equi-join by cell whatever their number."""
    n = gallery.count()
    cells = max(8, n // (SPREAD * CELL))
    block = _dealt(blocks or queries.count() // BLOCK + 1)
    made = queries.select(block.alias("block"), _vector(*more)).groupBy("block").agg(F.collect_list("v").alias("vs"))  # about BLOCK of them
    sent = made.select("vs", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    part = _dealt(n // (cells * CELL) + 1, seed=1)
    groups = gallery.select(_dealt(cells).cast("int").alias("cell"), part.alias("part"), _vector()).groupBy("cell", "part").agg(F.collect_list("v").alias("gs"))  # about CELL of them
    return groups.join(sent, "cell").select("vs", "gs").mapInArrow(_each(work), schema)


def _each(work: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vs, gs in zip(batch.column("vs"), batch.column("gs"), strict=True):
                yield from work(vs.values, gs.values)

    return run


def _pairs(qi, ql, gi, gl, s, mask) -> pa.RecordBatch:
    i, j = np.nonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (qi[i], ql[i].astype(np.int32), gi[j], gl[j].astype(np.int32), s[i, j])], names=["q", "ql", "g", "gl", "s"])


def _first(s: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """mask of those that can be among the first k of their row."""
    if k >= s.shape[1]:
        return mask
    ranked = np.where(mask, s, -2.0)
    limit = np.partition(ranked, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return mask & (ranked >= limit[:, None])


def compared(queries: DataFrame, gallery: DataFrame, k: int | None = None, apart: int | None = None, hits: bool = False) -> DataFrame:
    """(q, ql, g, gl, s) of each query and the other vectors of the gallery; apart: see allowed_pairs; k: only those that can be among its
    first k; hits: only those of the query's label."""

    def work(vs: pa.StructArray, gs: pa.StructArray) -> Iterator[pa.RecordBatch]:
        (qi, ql, a), (gi, gl, b) = unit_rows(vs), unit_rows(gs)
        s, mask = similar(a, b), allowed_pairs(qi, gi, apart)
        if hits:
            mask &= ql[:, None] == gl[None, :]
        yield _pairs(qi, ql, gi, gl, s, _first(s, mask, k) if k else mask)

    return block_pairs(queries, gallery, work, PAIRS)


def ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """pairs with rank: of each query by similarity, then id; k: only the first k."""
    out = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "g")).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def above_counts(vs: pa.StructArray, gs: pa.StructArray, apart: int | None) -> Iterator[pa.RecordBatch]:
    """(q, g, above): how many of a block of the gallery, of other labels than the query's, come before each hit (s, g) of each query."""
    (qi, ql, a), (gi, gl, b) = unit_rows(vs), unit_rows(gs)
    order = np.argsort(gi, kind="stable")
    gi, gl, b = gi[order], gl[order], b[order]
    s = similar(a, b)
    other = allowed_pairs(qi, gi, apart) & (ql[:, None] != gl[None, :])
    lists = vs.field("hits")
    out = []
    for i in range(len(qi)):
        hit = lists[i].values
        score, ids = (hit.field(c).to_numpy(zero_copy_only=False) for c in ("s", "g"))
        at = np.flatnonzero(other[i])
        at = at[np.argsort(-s[i, at], kind="stable")]  # equal ones by id
        falling = -s[i, at]
        above, to = np.searchsorted(falling, -score, "left"), np.searchsorted(falling, -score, "right")
        for j in np.flatnonzero(to > above).tolist():
            above[j] += np.searchsorted(gi[at[above[j] : to[j]]], ids[j], "left")
        out.append((np.full(len(ids), qi[i]), ids, above))
    q, g, above = (np.concatenate(x) for x in zip(*out, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(g), pa.array(above.astype(np.int64))], names=["q", "g", "above"])


#: Cells of a gallery in `nearest`, whatever its size: tasks that a block of queries goes to.
NEAREST_CELLS = 32
#: Groups of vectors in `pivot_cells`, whatever their number: tasks that a block of pivots goes to.
PIVOT_GROUPS = 64


def pivot_cells(vectors: DataFrame, stride: int) -> DataFrame:
    """(cell, vec_id, s): for each vector the most similar of all whose vec_id is divisible by stride, the least id among equals; no row without any such.

    The vectors are dealt to groups, and all pivots, as blocks, to each group: a block of vectors meets them one after another and keeps its best. So neither the driver nor a task holds
    all pivots, however many there are."""
    n = vectors.count()
    block = _dealt(n // (4 * BLOCK) + 1).cast("int")
    made = vectors.select(block.alias("block"), _vector()).groupBy("block").agg(F.collect_list("v").alias("vs"))  # about 4 BLOCK of them
    pivots = vectors.where(F.col("vec_id") % stride == 0)
    part = _dealt(n // (stride * CELL) + 1, seed=1)
    parts = pivots.select(part.alias("part"), _vector()).groupBy("part").agg(F.collect_list("v").alias("gs"))  # about CELL of them
    groups = PIVOT_GROUPS
    sent = parts.select("gs", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, cell, most = None, None, None, None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, ids, most)], names=["cell", "vec_id", "s"])

        for batch in batches:
            for block, vs, gs in zip(batch.column("block").to_pylist(), batch.column("vs"), batch.column("gs"), strict=True):
                if block != at:
                    if at is not None:
                        yield rows()
                    at, (ids, _, unit) = block, unit_rows(vs.values)
                    most, cell = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
                names, _, other = unit_rows(gs.values)
                order = np.argsort(names, kind="stable")
                for start in range(0, len(ids), BLOCK):
                    own = slice(start, start + BLOCK)
                    s = similar(unit[own], other[order])
                    first = s.argmax(axis=1)  # the first among equals: the least id
                    found, name = s[np.arange(len(s)), first], names[order][first]
                    better = (found > most[own]) | (found == most[own]) & (name < cell[own])
                    most[own], cell[own] = np.where(better, found, most[own]), np.where(better, name, cell[own])
        if at is not None:
            yield rows()

    # The vectors come first: a join goes through its left rows and keeps the right ones of a group at hand. Few bytes can be much work, so the number of tasks is given.
    left = made.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).repartition(groups, "group")
    met = left.join(sent.repartition(groups, "group").hint("merge"), "group").select("block", "vs", "gs")
    return met.mapInArrow(best, "cell long, vec_id long, s double")


def nearest(queries: DataFrame, gallery: DataFrame, k: int, apart: int | None = None) -> DataFrame:
    """(q, ql, g, gl, s, rank): the first k of each query, exactly, each pair made once.

    A block of queries meets all parts of a cell of the gallery one after another and keeps its first k, so a query has k rows a cell, and the number of cells is fixed. Only
    similarities that reach the last of the first k so far are looked at further."""
    made = queries.select(_dealt(queries.count() // (4 * BLOCK) + 1).cast("int").alias("block"), _vector()).groupBy("block").agg(F.collect_list("v").alias("vs"))  # about 4 BLOCK of them
    cells = NEAREST_CELLS
    sent = made.select("block", "vs", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    part = _dealt(gallery.count() // (cells * CELL) + 1, seed=1)
    groups = gallery.select(_dealt(cells).cast("int").alias("cell"), part.alias("part"), _vector()).groupBy("cell", "part").agg(F.collect_list("v").alias("gs"))  # about CELL of them

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in batches:
            for block, cell, vs, gs in zip(batch.column("block").to_pylist(), batch.column("cell").to_pylist(), batch.column("vs"), batch.column("gs"), strict=True):
                if (block, cell) != at:
                    if first:
                        yield first.rows()
                    at, first = (block, cell), FirstOf(vs.values, k, apart)
                first.meet(gs.values)
        if first:
            yield first.rows()

    # The queries come first: a join goes through its left rows and keeps the right ones of a cell at hand.
    # Few bytes can be much work, so the number of tasks is given.
    dealt = lambda df: df.repartition(2 * cells, "cell")
    pairs = dealt(sent).join(dealt(groups), "cell").select("block", "cell", "vs", "gs").mapInArrow(best, PAIRS)
    return ranked(pairs, k)


class FirstOf:
    """The first k of a block of queries among all that it has met."""

    def __init__(self, vs: pa.StructArray, k: int, apart: int | None):
        self.ids, self.labels, self.unit = unit_rows(vs)
        self.k, self.apart = k, apart
        self.limit = np.full(len(self.ids), -np.inf)  # what another must reach
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # query's place, similarity, id, label

    def meet(self, gs: pa.StructArray) -> None:
        ids, labels, unit = unit_rows(gs)
        for start in range(0, len(self.ids), BLOCK):
            own = slice(start, start + BLOCK)
            s = self.unit[own] @ unit.T
            limit = self.limit[own]
            if not np.isfinite(limit).all():
                limit = np.maximum(limit, self.reached(self.ids[own], ids, s))
            i, j = np.nonzero(s >= limit[:, None] - 2e-9)  # rounding moves by half of 1e-9
            i += start
            allowed = self.ids[i] % self.apart != ids[j] % self.apart if self.apart else self.ids[i] != ids[j]
            i, j = i[allowed], j[allowed]
            if len(i):
                self.keep(own, i, np.round(s[i - start, j], 9) + 0.0, ids[j], labels[j])

    def reached(self, qi: np.ndarray, gi: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The k-th similarity of each query among these; none where there are fewer."""
        if s.shape[1] < self.k:
            return np.full(len(qi), -np.inf)
        return np.partition(np.where(allowed_pairs(qi, gi, self.apart), s, -np.inf), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]

    def keep(self, own: slice, i: np.ndarray, s: np.ndarray, g: np.ndarray, label: np.ndarray) -> None:
        here = (self.held[0] >= own.start) & (self.held[0] < own.stop)
        i, s, g, label = (np.concatenate([x[here], y]) for x, y in zip(self.held, (i, s, g, label), strict=True))
        order = np.lexsort((g, -s, i))
        i, s, g, label = (x[order] for x in (i, s, g, label))
        starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        last = place == self.k - 1
        self.limit[i[last]] = s[last]
        self.held = [np.concatenate([x[~here], y[place < self.k]]) for x, y in zip(self.held, (i, s, g, label), strict=True)]

    def rows(self) -> pa.RecordBatch:
        i, s, g, label = self.held
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[i], self.labels[i].astype(np.int32), g, label.astype(np.int32), s)], names=["q", "ql", "g", "gl", "s"])


def hit_ranks(queries: DataFrame, gallery: DataFrame, apart: int | None = None) -> DataFrame:
    """(q, rank, seen) for each hit (a vector of the query's label) in the full ranking of the gallery, seen being its place among the hits, and (q, NULL, NULL) for
    a query without one.

    Only hits are ever rows. A first pass of blocks finds their similarities; a second one takes them along with the queries, and each pair of blocks
    returns how many others stand above each hit, which are added up before they are shuffled."""
    hits = written(compared(queries, gallery, apart=apart, hits=True).select("q", "g", "s"), "hits")
    n, total = gallery.count(), hits.count()
    chunk = _dealt(n // CELL, "g")  # a query of very many hits goes along in several rows
    lists = hits.groupBy(F.col("q").alias("vec_id"), chunk.alias("chunk")).agg(F.collect_list(F.struct("s", "g")).alias("hits"))  # about CELL of them at most
    carried = queries.select("vec_id", "label", "embedding").join(lists, "vec_id")
    blocks = max(queries.count() // BLOCK, total // (16 * CELL)) + 1
    above = block_pairs(carried, gallery, lambda vs, gs: above_counts(vs, gs, apart), "q long, g long, above long", blocks, "hits")
    counted = above.groupBy("q", "g").agg(F.sum("above").alias("above"))
    seen = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "g")).cast("long")
    found = hits.withColumn("seen", seen).join(counted, ["q", "g"], "left").select("q", (F.col("seen") + F.coalesce("above", F.lit(0).cast("long"))).alias("rank"), "seen")
    # Queries that have anyone to be compared with.
    able = queries.select(F.col("vec_id").alias("q"))
    if apart:
        crowd = gallery.groupBy((F.col("vec_id") % apart).alias("own")).agg(F.count("*").alias("n"))
        able = able.withColumn("own", F.col("q") % apart).join(crowd, "own", "left").where(F.coalesce("n", F.lit(0)) < n).select("q")
    return able.where(F.lit(n > 1)).join(found, "q", "left")


#: A similarity counts in steps of 1e-9, so twice its distance to 1, and one more for a hit, is a number of 32 bits.
ONE = 10**9
#: Vectors of a gallery for each range of similarities whose numbers of a query are sorted at once.
SORTED = 1 << 22


def hit_measures(queries: DataFrame, gallery: DataFrame, apart: int | None = None, k: int = 10) -> DataFrame:
    """(q, rel, ap, ranks) of each query that has anyone to be compared with: its hits (see hit_ranks) in the full ranking of the gallery, the mean over them of place among hits by rank (NULL without
    any), and the ranks of the first k of them.

    No pair is a row: a block of the gallery gives a query one array of 4 bytes for each of its vectors, which meet sorted by query, range of similarity and the ids of the block.
    A task holds one query's numbers of one range at a time. Each pair is made once."""
    n = gallery.count()
    ranges = max(1, min(4096, n // SORTED))
    step = (4 * ONE + 2 + ranges - 1) // ranges
    kind = gallery.schema["embedding"].dataType.simpleString()
    v = f"struct<vec_id:long,label:int,embedding:{kind}>"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, CELL):
            whole = table.combine_chunks().to_batches()[0].to_struct_array()
            yield pa.RecordBatch.from_arrays([whole.field("vec_id").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)], names=["first", "gs"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vs, first, gs in zip(batch.column("vs"), batch.column("first").to_pylist(), batch.column("gs"), strict=True):
                (qi, ql, a), (gi, gl, b) = unit_rows(vs.values), unit_rows(gs.values)
                order = np.argsort(gi, kind="stable")
                gi, gl, b = gi[order], gl[order], b[order]
                number = (2 * (ONE - np.rint(a @ b.T * ONE).astype(np.int64)) + (ql[:, None] == gl[None, :])).astype(np.uint32)
                mask = allowed_pairs(qi, gi, apart)
                found = []
                for i in range(len(qi)):
                    own = number[i][mask[i]]
                    if ranges == 1:
                        found.append((qi[i], 0, own))
                    else:
                        place = own // step
                        found += [(qi[i], int(r), own[place == r]) for r in np.unique(place)]
                found = [x for x in found if len(x[2])]
                columns = [pa.array([int(x[0]) for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([first] * len(found), pa.int64()), pa.array([x[2].tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "range", "first", "numbers"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in query_runs(batches):
            above = seen = 0
            total, ranks = 0.0, []
            for x in rows[1]:
                hit = ordered_hits(x)
                at = np.flatnonzero(hit) + 1 + above
                total += float((np.arange(seen + 1, seen + len(at) + 1) / at).sum())
                ranks += at[: k - len(ranks)].tolist()
                above, seen = above + len(hit), seen + len(at)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]]), pa.array([seen]), pa.array([total / seen if seen else None], pa.float64()), pa.array([ranks], pa.list_(pa.int64()))], names=["q", "rel", "ap", "ranks"])

    cells = min(512, max(8, n // (8 * CELL)))
    sides = [df.select("vec_id", F.col("label").cast("int").alias("label"), "embedding") for df in (queries, gallery)]
    blocks = sides[1].repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(packed, f"first long, gs array<{v}>").withColumn("cell", _dealt(cells, "first").cast("int"))
    made = sides[0].select(_dealt(queries.count() // BLOCK + 1).alias("block"), _vector()).groupBy("block").agg(F.collect_list("v").alias("vs"))  # about BLOCK of them
    sent = made.select("vs", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    pairs = sent.join(blocks, "cell").select("vs", "first", "gs").mapInArrow(numbers, "q long, range int, first long, numbers binary")
    return pairs.repartition("q").sortWithinPartitions("q", "range", "first").mapInArrow(measured, "q long, rel long, ap double, ranks array<long>")


def query_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(q, its numbers, one array for each range) of batches (q, range, numbers) sorted by q and range."""
    parts = ((q, r, np.frombuffer(x, np.uint32)) for batch in batches for q, r, x in zip(*(batch.column(c).to_pylist() for c in ("q", "range", "numbers")), strict=True))
    for q, own in groupby(parts, key=lambda x: x[0]):
        yield q, (np.concatenate([x[2] for x in one]) for _, one in groupby(own, key=lambda x: x[1]))


def ordered_hits(numbers: np.ndarray) -> np.ndarray:
    """Whether each is a hit, from the most similar on. The numbers are given by id, which decides among equal similarities; it is asked for only where a hit and another are equal."""
    plain = np.sort(numbers)
    if ((plain[1:] - plain[:-1] == 1) & (plain[:-1] % 2 == 0)).any():
        plain = numbers[np.argsort(numbers >> 1, kind="stable")]
    return plain % 2 == 1


class VectorIndex:
    """Vectors in the cells of pivots, with the least and greatest angle of a cell's vectors to its pivot.

    vectors: a table (cell, part, vec_id, label, embedding), of which no (cell, part) holds many more than CELL. On the sphere the triangle inequality
    holds for angles: a vector of a cell is no nearer to a query than the query's angle to the pivot less the greatest, or the least less it."""

    def __init__(self, vectors: DataFrame, pivots: np.ndarray, names: list[int], sizes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.vectors, self.pivots, self.names, self.sizes, self.low, self.high = vectors, pivots, names, sizes, low, high

    def cells(self) -> list[tuple[int, int, float, float]]:
        """(pivot's vec_id, vectors, least cosine, greatest cosine) of each cell that holds any."""
        return [(v, int(n), float(np.cos(h)), float(np.cos(l))) for v, n, l, h in zip(self.names, self.sizes, self.low, self.high, strict=True) if n]


def build_index(gallery: DataFrame, stride: int | None = None) -> VectorIndex:
    """Pivots are all vectors whose vec_id is divisible by stride (without any the 16 of the least hashes); every vector goes to the cell of the most similar pivot, the one with the least id
    among equals. Without a stride it is about the square root of all and the pivots are MAX_PIVOTS of these at most. As all pivots go to all tasks, a caller who gives a stride answers for their number; pivot_cells has no such bound."""
    n = gallery.count()
    step = stride or max(1, n // min(MAX_PIVOTS, int(n**0.5) + 1))
    some = gallery.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"))
    chosen = some.where(F.col("vec_id") % step == 0)
    rows = (chosen if stride else chosen.limit(MAX_PIVOTS)).collect() or some.limit(16).collect()
    rows = sorted(rows, key=lambda r: r.vec_id)
    pivots = np.array([r.embedding for r in rows], float) if rows else np.zeros((0, 1))
    norm = np.sqrt((pivots * pivots).sum(axis=1))
    pivots = pivots / np.where(norm > 0, norm, 1)[:, None]
    shared = gallery.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, m = unit_rows(batch.to_struct_array())
            s = similar(m, shared.value)
            cell = s.argmax(axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle), *(batch.column(c) for c in ("vec_id", "label", "embedding"))], names=["cell", "angle", "vec_id", "label", "embedding"])

    if not rows:
        empty = gallery.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("part"), "vec_id", "label", "embedding").limit(0)
        return VectorIndex(empty, pivots, [], np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    kind = gallery.schema["embedding"].dataType.simpleString()
    placed = written(gallery.select("vec_id", F.col("label").cast("int").alias("label"), "embedding").mapInArrow(assign, f"cell int, angle double, vec_id long, label int, embedding {kind}"), "index")
    sizes, low, high = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.zeros(len(rows))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row for each pivot
        sizes[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    counts = gallery.sparkSession.createDataFrame([(i, max(1, int(-(-x // CELL)))) for i, x in enumerate(sizes.tolist())], "cell int, parts long")
    placed, part = placed.join(F.broadcast(counts), "cell"), F.pmod(F.xxhash64("vec_id"), F.col("parts"))  # a row for each pivot
    return VectorIndex(placed.select("cell", part.cast("long").alias("part"), "vec_id", "label", "embedding"), pivots, [r.vec_id for r in rows], sizes, low, high)


def search_index(index: VectorIndex, queries: DataFrame, k: int, apart: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((q, ql, g, gl, s, rank): the first k of each query, exactly; (q, visited): how many cells were looked into).

    The first round looks into a query's nearest cells, until these hold 4 k vectors. The k-th similarity found (or none) then rules out every cell whose bound is
    below it; the second round looks into the rest."""
    spark = queries.sparkSession
    used = np.flatnonzero(index.sizes)
    if not len(used):
        return spark.createDataFrame([], f"{PAIRS}, rank long"), queries.select(F.col("vec_id").alias("q"), F.lit(0).cast("long").alias("visited"))
    shared = spark.sparkContext.broadcast((index.pivots[used], index.sizes[used], index.low[used], index.high[used], used.astype(np.int32)))
    asked = queries.select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    kind = asked.schema["embedding"].dataType.simpleString()
    schema = f"vec_id long, label int, embedding {kind}, cells array<int>"

    def choose(batch: pa.RecordBatch, limit: np.ndarray | None) -> pa.RecordBatch:
        pivots, sizes, low, high, names = shared.value
        _, _, m = unit_rows(batch.to_struct_array())
        angle = np.arccos(np.clip(m @ pivots.T, -1, 1))
        order = np.argsort(angle, axis=1, kind="stable")
        filled = np.cumsum(sizes[order], axis=1)
        near = np.empty(angle.shape, bool)
        np.put_along_axis(near, order, np.concatenate([np.ones((len(m), 1), bool), filled[:, :-1] < 4 * k], axis=1), axis=1)
        if limit is not None:
            nearest = np.maximum(0, np.maximum(angle - high, low - angle))
            near = ~near & (np.cos(nearest) >= limit[:, None] - 1e-6)
        i, j = np.nonzero(near)
        cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(m) + 1)), pa.int32()), pa.array(names[j]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "embedding")), cells], names=["vec_id", "label", "embedding", "cells"])

    def first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (choose(b, None) for b in slices(batches))

    def other_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (choose(b, b.column("bound").to_numpy(zero_copy_only=False)) for b in slices(batches))

    def work(vs: pa.StructArray, gs: pa.StructArray) -> Iterator[pa.RecordBatch]:
        (qi, ql, a), (gi, gl, b) = unit_rows(vs), unit_rows(gs)
        s, mask = similar(a, b), allowed_pairs(qi, gi, apart)
        yield _pairs(qi, ql, gi, gl, s, _first(s, mask, k))

    blocks = asked.count() // BLOCK + 1
    parts = index.vectors.groupBy("cell", "part").agg(F.collect_list(_vector()).alias("gs"))  # about CELL of them
    where = index.vectors.select("cell", "part").distinct()

    def met(chosen: DataFrame) -> DataFrame:
        sent = chosen.select(F.explode("cells").alias("cell"), _vector(), _dealt(blocks).alias("block")).join(where, "cell")
        grouped = sent.groupBy("cell", "part", "block").agg(F.collect_list("v").alias("vs"))  # about BLOCK of them
        return grouped.join(parts, ["cell", "part"]).select("vs", "gs").mapInArrow(_each(work), PAIRS)

    first = asked.mapInArrow(first_cells, schema)
    found = written(ranked(met(first), k), "near")
    bounds = found.where(F.col("rank") == k).select(F.col("q").alias("vec_id"), F.col("s").alias("bound"))
    second = asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0))).mapInArrow(other_cells, schema)
    whole = ranked(found.drop("rank").unionByName(met(second)), k)
    size = lambda df: df.select(F.col("vec_id").alias("q"), F.size("cells").alias("n"))
    return whole, size(first).union(size(second)).groupBy("q").agg(F.sum("n").alias("visited"))


def reciprocal_sets(neighbours: DataFrame) -> DataFrame:
    """(i, near): the expanded set of each row of neighbours (q, g, rank): its own neighbours, and by their rank those of each neighbour of which
    the set so far holds two thirds or more."""
    lists = neighbours.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("near"))  # k of them
    theirs = neighbours.join(lists.select(F.col("q").alias("g"), F.col("near").alias("other")), "g")
    ordered = theirs.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("others"))
    taken = F.aggregate("others", F.col("near"), lambda r, n: F.when(3 * F.size(F.array_intersect(r, n)) >= 2 * F.size(n), F.array_union(r, n)).otherwise(r))
    return lists.join(ordered, "q", "left").select(F.col("q").alias("i"), F.when(F.col("others").isNull(), F.col("near")).otherwise(taken).alias("near"))


def reranked(queries: DataFrame, gallery: DataFrame, index: VectorIndex | None = None, k: int = 7, first: int = 20) -> DataFrame:
    """(q, g, s, jaccard, score, rank): the first rows of each query by half the cosine and half the Jaccard similarity of the expanded sets. Neighbours come from the index or, without
    one, from all pairs in blocks: an index that can rule out few cells sends every vector to nearly all of them, whose number grows.

    Sets meet by their members, so only rows that share one are joined; of all others, whose Jaccard similarity is 0, the most similar `first` are enough."""
    search = lambda rows, n: search_index(index, rows, n)[0] if index else nearest(rows, gallery, n)
    near = search(gallery, k)
    sets = written(reciprocal_sets(near.select("q", "g", "rank")), "sets")
    members = sets.select("i", F.size("near").alias("n"), F.explode("near").alias("m"))
    asked = queries.select(F.col("vec_id").alias("i")).join(members, "i").withColumnsRenamed({"i": "q", "n": "qn"})
    shared = asked.join(members.withColumnsRenamed({"i": "g", "n": "gn"}), "m").where("q <> g").groupBy("q", "g", "qn", "gn").agg(F.count("*").alias("both"))
    overlap = shared.select("q", "g", (F.col("both") / (F.col("qn") + F.col("gn") - F.col("both"))).alias("jaccard"))
    straight = search(queries, first)
    pairs = overlap.unionByName(straight.select("q", "g", F.lit(0.0).alias("jaccard"))).groupBy("q", "g").agg(F.max("jaccard").alias("jaccard"))
    side = lambda df, name: df.select(F.col("vec_id").alias(name), F.col("embedding").alias(f"{name}v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(dot("qv", "qv")) * F.sqrt(dot("gv", "gv"))
    cos = F.round(F.when(norms > 0, dot("qv", "gv") / norms).otherwise(0.0), 9)
    scored = pairs.join(side(queries, "q"), "q").join(side(gallery, "g"), "g").select("q", "g", cos.alias("s"), "jaccard")
    scored = scored.withColumn("score", F.round(0.5 * F.col("s") + 0.5 * F.col("jaccard"), 9))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "g")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= first)
