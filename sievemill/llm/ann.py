"""Nearest neighbours by largest inner product with collision-counting hashing.

Inner products become distances by one more coordinate, so that the longest vector sets the scale.  Each of a
fixed number of random projections is one sorted array; a query opens a window around its own projection in
each and widens all windows step by step (virtual rehashing).  A vector that falls in enough windows collides
and is verified by its exact inner product.

The arrays are cut into cells, by projections again: a tree fitted on a bounded sample splits where a projection
spreads most, and every vector is dealt to a cell; a cell's rows stand in blocks of bounded size.  A query is first
searched for in its own cell, by widening windows.  How far its results there are sets the width of its windows
everywhere else: with it, it visits the cells of which enough projections meet its windows.  No vector of another
cell can collide, so cells are left out without loss, and vectors that cluster are met by few queries.  Where the
neighbours of a query are hardly nearer than other vectors, windows hold most of them, and most are verified.

Defined results: vectors that are null, empty, zero or hold a null or a non-finite component take no
part, nor do rows without an id.  Each row whose id is divisible is a query, repeated ones too; every row
but the query's own is a candidate, also one with the same id.  Vectors of another length are no
candidates; of equal scores the smaller vec_id is nearer; products that overflow count as infinite, undefined
ones come last; with fewer candidates than asked for all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_bucket, map_arrow, materialize, table

TOP, EVERY = 20, 20
#: Rows of a block and queries of a chunk on average: what one task holds at a time.
BLOCK_ROWS, CHUNK_ROWS = 8192, 2048
#: Projections, share of them a vector must collide in, first half-width and its growth (in units of the scale).
PROJECTIONS, COLLIDE, WIDTH, GROWTH = 32, 0.5, 0.3, 1.25
#: Half-width over distance at which a vector at that distance collides almost surely.
SURE = 1.15
#: Components of the sample that the cells are fitted on at most, its rows at most, and those of a cell at least.
SAMPLE_VALUES, SAMPLE_ROWS, LEAF = 1 << 22, 1 << 15, 8
#: Share of a block's products, up to which they are computed for the collided vectors alone.
FEW = 0.05


def valid(column: str) -> Column:
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


@functools.lru_cache(8)
def projections(dims: int, most: int = PROJECTIONS, seed: int = 3) -> np.ndarray:
    """Random directions, orthogonal as far as there are dimensions, of length sqrt(dims)."""
    draw = np.random.default_rng(seed)
    parts = [np.linalg.qr(draw.normal(size=(dims, dims)))[0] for _ in range(math.ceil(most / dims))]
    return np.concatenate(parts)[:most] * math.sqrt(dims)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths that neither overflow nor vanish on the way."""
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


def points(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Projections of vectors over ``scale``, the longest of all, with the coordinate that makes them unit vectors."""
    unit = vectors / scale
    rest = np.sqrt(np.maximum(1 - (unit**2).sum(1), 0))
    return (np.concatenate([unit, rest[:, None]], 1) @ projections(vectors.shape[1] + 1).T).astype(np.float32)


def query_points(queries: np.ndarray) -> np.ndarray:
    unit = queries / lengths(queries)[:, None]
    return (np.concatenate([unit, np.zeros((len(unit), 1))], 1) @ projections(queries.shape[1] + 1).T).astype(np.float32)


def half_widths(bound: np.ndarray, queries: np.ndarray, scale: float) -> np.ndarray:
    """Half-widths at which all vectors with an inner product over ``bound`` collide; infinite without a bound."""
    with np.errstate(all="ignore"):
        share = bound / lengths(queries) / scale
        wide = SURE * np.sqrt(np.maximum(2 - 2 * share, 0))
    return np.where(np.isfinite(wide), wide, np.inf)


@dataclass
class Cells:
    """A tree over projections: inner nodes have a projection and the value it splits at; leaves are cells."""

    scale: float
    line: list[int]
    value: list[float]
    below: list[tuple[int, int]]

    @classmethod
    def fit(cls, sample: np.ndarray | None, scale: float, rows: int, block_rows: int) -> Cells:
        tree = cls(scale, [], [], [])
        p = None if sample is None else points(sample, scale)

        def grow(own: np.ndarray | None, share: float) -> int:
            number = len(tree.line)
            tree.line.append(-1)
            tree.value.append(0.0)
            tree.below.append((-1, -1))
            if own is None or share * rows <= block_rows or len(own) < 2 * LEAF:
                return number
            part = p[own]
            for line in np.argsort(-part.std(0)).tolist():
                middle = float(np.median(part[:, line]))
                left = part[:, line] < middle
                n = int(left.sum())
                if LEAF <= n <= len(own) - LEAF:
                    tree.line[number], tree.value[number] = line, middle
                    tree.below[number] = (grow(own[left], share * n / len(own)), grow(own[~left], share * (1 - n / len(own))))
                    break
            return number

        grow(None if p is None else np.arange(len(p)), 1.0)
        return tree

    def of(self, p: np.ndarray) -> np.ndarray:
        """The cell of each row of projections."""
        out = np.zeros(len(p), np.int64)
        todo = [(0, np.arange(len(p)))]
        while todo:
            node, own = todo.pop()
            if self.line[node] < 0 or not len(own):
                out[own] = node
                continue
            left = p[own, self.line[node]] < self.value[node]
            todo += [(self.below[node][0], own[left]), (self.below[node][1], own[~left])]
        return out


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, the same for the same vector wherever it stands."""
    with np.errstate(all="ignore"):
        return (vectors * query).sum(1)


class Block:
    """Vectors with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, p: np.ndarray, copies: np.ndarray):
        self.ids, self.vectors, self.copies = ids, vectors, copies
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p, self.order.T, 0).T.copy()
        self.need = math.ceil(COLLIDE * len(self.order))

    def edges(self, at: np.ndarray, width) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window in each array."""
        lo = np.stack([np.searchsorted(s, at[:, i] - width) for i, s in enumerate(self.sorted)], 1)
        hi = np.stack([np.searchsorted(s, at[:, i] + width, "right") for i, s in enumerate(self.sorted)], 1)
        return lo, hi

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often each vector stands in the stretches lo to hi of the arrays."""
        n = len(self.ids)
        start = np.tile(np.arange(len(self.order)) * n, len(lo) // len(self.order))
        parts = [self.order.ravel()[a:b] for a, b in zip((start + lo).tolist(), (start + hi).tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)

    def _best(self, q: int, query: np.ndarray, own: int, place: np.ndarray, top: int, out: list) -> float:
        """Adds the best of the collided vectors to ``out``; gives the score of the last, -inf if they are fewer."""
        score = exact(self.vectors[place], query)
        copies = self.copies[place]
        same = np.flatnonzero(self.ids[place] == own)
        mine = same[(self.vectors[place[same]] == query).all(1)]
        if len(mine):
            copies = copies.copy()
            copies[mine] -= 1
        rank = np.where(np.isnan(score), -np.inf, score)
        best = np.lexsort((self.ids[place], np.isnan(score), -rank))
        best = best[copies[best] > 0][:top]
        if len(best):
            out.append((np.full(len(best), q), self.ids[place[best]], score[best], copies[best]))
        many = np.cumsum(copies[best])
        return float(rank[best[np.searchsorted(many, top)]]) if len(many) and many[-1] >= top else -np.inf

    def widen(self, own: np.ndarray, queries: np.ndarray, scale: float, top: int = TOP) -> list:
        """Results of queries of this block's own cell, by windows that widen until the results are surely all."""
        out: list = []
        at, n = query_points(queries), len(self.ids)
        for q in range(len(queries)):
            hits, found = np.zeros(n, np.int64), np.zeros(0, np.int64)
            lo = hi = np.array([np.searchsorted(s, at[q, i]) for i, s in enumerate(self.sorted)])
            width, last, results = WIDTH, -1, []
            while len(found) < n:
                new_lo, new_hi = (x[0] for x in self.edges(at[q : q + 1], width))
                hits += self.count(np.concatenate([new_lo, hi]), np.concatenate([lo, new_hi]))
                lo, hi = new_lo, new_hi
                found = np.flatnonzero(hits >= self.need)
                if len(found) >= top and len(found) > last:
                    last, results = len(found), []
                    bound = self._best(q, queries[q], own[q], found, top, results)
                if len(found) >= top and width >= half_widths(np.array([bound]), queries[q : q + 1], scale)[0]:
                    break
                width *= GROWTH
                if len(found) > n // 4:
                    found = np.arange(n)
                    results = []
                    self._best(q, queries[q], own[q], found, top, results)
            out += results
        return out

    def collided(self, own: np.ndarray, queries: np.ndarray, bound: np.ndarray, scale: float, top: int = TOP) -> list:
        """Results of queries of other cells: vectors that collide in windows as wide as the bounds allow."""
        out: list = []
        width, n = half_widths(bound, queries, scale), len(self.ids)
        lo, hi = self.edges(query_points(queries), width)
        for begin in range(0, len(queries), 64):
            part = range(begin, min(begin + 64, len(queries)))
            # windows that hold most of a block hold most vectors often enough
            all_ = [(hi[q] - lo[q]).sum() >= 0.9 * len(self.order) * n for q in part]
            found = [np.arange(n) if a else np.flatnonzero(self.count(lo[q], hi[q]) >= self.need) for q, a in zip(part, all_, strict=True)]
            if sum(map(len, found)) > FEW * n * len(part):
                with np.errstate(all="ignore"):
                    near = queries[begin : begin + 64] @ self.vectors.T
                    # what rounding may change
                    slack = 1e-9 * np.outer(lengths(queries[begin : begin + 64]), self.long)
                    beyond = near + slack >= bound[begin : begin + 64, None]
                    found = [x[~(beyond[i, x] == False)] if np.isfinite(near[i]).all() else x for i, x in enumerate(found)]  # noqa: E712
            for q, place in zip(part, found, strict=True):
                if len(place):
                    self._best(q, queries[q], own[q], place, top, out)
        return out

    @functools.cached_property
    def long(self) -> np.ndarray:
        return lengths(self.vectors)


def _matrix(column, dims: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


_FOUND = "query_id long, query_hash long, query_copies long, vec_id long, score double, copies long"


def _meet(blocks: DataFrame, queries: DataFrame, sent, top: int, far: bool) -> DataFrame:
    """Results of queries in the blocks that they are dealt to."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.float64() if n == "score" else pa.int64() for n in names]

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = []
        if left.num_rows and right.num_rows:
            dims = key[0].as_py()
            scale = sent.value[dims].scale
            block = Block(left.column("id").to_numpy(), _matrix(left.column("v"), dims), _matrix(left.column("p"), PROJECTIONS).astype(np.float32), left.column("copies").to_numpy())
            own, vectors = right.column("id").to_numpy(), _matrix(right.column("v"), dims)
            if far:
                found = block.collided(own, vectors, right.column("bound").to_numpy(zero_copy_only=False), scale, top)
            else:
                found = block.widen(own, vectors, scale, top)
        if not found:
            return pa.table([pa.array([], k) for k in kinds], names)
        q, ids, score, copies = (np.concatenate(x) for x in zip(*found, strict=True))
        asked = [right.column(c).to_numpy()[q] for c in ("id", "hash", "copies")]
        return pa.table([*asked, ids, score, copies], names)

    keys = ("dims", "cell", "sub", "chunk")
    return blocks.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, _FOUND)


def _dealt(placed: DataFrame, asked: DataFrame, cells: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Blocks, once for each chunk of the queries that visit their cell, and queries for each block of theirs."""
    per = asked.groupBy("dims", "cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    # a row for each cell that is visited
    info = cells.join(per, ["dims", "cell"]).select(F.col("dims").alias("d"), F.col("cell").alias("c"), "subs", "chunks")
    on = (F.col("dims") == F.col("d")) & (F.col("cell") == F.col("c"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = placed.join(F.broadcast(info), on).withColumn("sub", F.pmod(F.xxhash64("id", "v"), F.col("subs")).cast("int")).withColumn("chunk", span("chunks"))
    queries = asked.join(F.broadcast(info), on).withColumn("chunk", F.pmod(F.xxhash64("id", "hash", F.lit(5)), F.col("chunks")).cast("int")).withColumn("sub", span("subs"))
    # columns of their own for each side, which come from one table
    own = lambda df: df.drop("d", "c").select(*[F.col(x).alias(f"own_{x}") for x in df.columns if x not in ("d", "c")]).toDF(*[x for x in df.columns if x not in ("d", "c")])
    return own(blocks), own(queries)


def _place(rows: DataFrame, sent) -> DataFrame:
    """Adds each vector's projections and cell, and the cell in which a query looks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                tree, vectors = sent.value[d], _matrix(part.column("v"), d)
                p = points(vectors, tree.scale)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), PROJECTIONS).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array(tree.of(p)), pa.array(tree.of(query_points(vectors)))], [*part.schema.names, "p", "cell", "first_cell"])

    return map_arrow(rows, run, "id long, v array<double>, copies long, dims int, hash long, p array<float>, cell long, first_cell long")


def _visits(asked: DataFrame, spans: dict, sent_trees, spark: SparkSession) -> DataFrame:
    """Queries with a bound, once for each cell but their own of which enough projections meet their windows."""
    sent = spark.sparkContext.broadcast(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                vectors = _matrix(part.column("v"), d)
                at = query_points(vectors)
                width = half_widths(part.column("bound").to_numpy(zero_copy_only=False), vectors, sent_trees.value[d].scale)[:, None]
                numbers, low, high = sent.value[d]
                need, own = math.ceil(COLLIDE * PROJECTIONS), part.column("first_cell").to_numpy()
                rows, cells = [], []
                for c, number in enumerate(numbers.tolist()):
                    meets = ((at + width >= low[c]) & (at - width <= high[c])).sum(1) >= need
                    hit = np.flatnonzero(meets & (own != number))
                    rows.append(hit)
                    cells.append(np.full(len(hit), number))
                row, cell = np.concatenate(rows), np.concatenate(cells)
                for begin in range(0, len(row), 4096):
                    chosen = part.take(pa.array(row[begin : begin + 4096]))
                    yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(cell[begin : begin + 4096])], [*chosen.schema.names, "cell"])

    return map_arrow(asked.select("id", "v", "copies", "dims", "hash", "first_cell", "bound"), run, "id long, v array<double>, copies long, dims int, hash long, first_cell long, bound double, cell long")


def _fit(rows: DataFrame, block_rows: int) -> dict[int, Cells]:
    """The tree of each vector length.  A sample is collected of lengths that fill more than one block."""
    most = F.array_max(F.transform("v", F.abs))
    length = most * F.sqrt(F.aggregate(F.transform("v", lambda x: (x / most) * (x / most)), F.lit(0.0), lambda a, x: a + x))
    trees = {}
    for row in rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(length).alias("scale")).collect():
        dims, n, sample = row["dims"], row["n"], None
        # lengths that are too large for a double still set a finite scale
        scale = min(row["scale"] * (1 + 1e-12), np.finfo(float).max)
        if n > block_rows:
            size = min(SAMPLE_ROWS, max(2 * LEAF, SAMPLE_VALUES // dims))
            share = min(1_000_000, 1 + int(1_200_000 * size / n))
            found = rows.where((F.col("dims") == dims) & (hash_bucket("hash") < share)).select("hash", "id", "v").toArrow()
            sample = _matrix(found.take(np.lexsort((found.column("id").to_numpy(), found.column("hash").to_numpy()))[:size]).column("v"), dims)
        trees[dims] = Cells.fit(sample, scale, n, block_rows)
    return trees


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.where(valid("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    # rows that are alike in id and vector stand together
    rows = materialize(rows.groupBy("id", "v").agg(F.count("*").alias("copies")).select("id", "v", "copies", F.size("v").alias("dims"), F.xxhash64("v").alias("hash")))
    trees = _fit(rows, block_rows)
    sent = spark.sparkContext.broadcast(trees)
    placed = materialize(_place(rows, sent))
    ends = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTIONS)]
    found = placed.groupBy("dims", "cell").agg(F.count("*").alias("n"), *ends).collect()
    spans = {}
    for d in trees:
        own = [r for r in found if r["dims"] == d]
        spans[d] = (np.array([r["cell"] for r in own]), np.array([[r[f"low{i}"] for i in range(PROJECTIONS)] for r in own], np.float32), np.array([[r[f"high{i}"] for i in range(PROJECTIONS)] for r in own], np.float32))
    cells = spark.createDataFrame([(r["dims"], r["cell"], math.ceil(r["n"] / block_rows)) for r in found], "dims int, cell long, subs int")
    asked = placed.where(F.col("id") % every == 0).select("id", "v", "copies", "dims", "hash", "first_cell")
    first = materialize(_meet(*_dealt(placed, asked.withColumn("cell", F.col("first_cell")), cells, chunk_rows), sent, top, far=False))
    order = [F.isnan("score"), F.desc("score"), "vec_id"]
    own = Window.partitionBy("query_id", "query_hash").orderBy(*order)
    many = F.sum(F.least("copies", F.lit(top))).over(own)
    last = first.withColumn("many", many).where((F.col("many") >= top) & ~F.isnan("score")).groupBy(F.col("query_id").alias("id"), F.col("query_hash").alias("hash")).agg(F.max("score").alias("bound"))
    bounded = asked.join(last, ["id", "hash"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    visits = materialize(_visits(bounded, spans, sent, spark))
    far = _meet(*_dealt(placed, visits, cells, chunk_rows), sent, top, far=True)
    # as many rows as there are copies, of candidates and of queries
    each = first.unionByName(far).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top)).cast("int"))))
    best = each.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return best.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("query_copies").cast("int")))).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
