"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is rotated by a fixed random orthogonal matrix and kept as the signs of its
coordinates plus two correction scalars (its length, and the inner product of its direction
with the code). Inner products with a query are estimated from packed bits (popcounts against
the query's four bit planes); the estimate has an error bound that shrinks with the dimension.
A candidate is reranked on its original vector only if its upper bound reaches the k-th best
lower bound, so what is left out is farther with high probability. The reranking is a block
product; pairs that may enter by it are summed in the order of the coordinates.

A small sample of rows gives every query a first lower bound and is clustered into cells of
directions. Each task sorts its rows by cell; a cell whose angle to a query cannot reach the
query's bound is passed over as a whole, and the codes decide inside the others. Where the
directions form clusters most cells are passed over; where they are spread evenly over many
dimensions no cell can be, and every code is compared.

The data are scanned once a chunk of queries; a chunk is a broadcast of bounded bytes. Every
task keeps the k best of its rows for each query, and those few meet by query in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of queries broadcast at once; rows held and rows and queries compared in one block.
QUERY_BYTES = 32 << 20
HELD_ROWS, ROW_BLOCK, QUERY_BLOCK = 16_384, 2_048, 256
#: Coordinates of pairs of a query and a row that are summed at once; pairs held beyond the best.
PAIR_VALUES, PAIRS_HELD = 4 << 20, 1 << 20
#: Rows (the first by a hash of their id) and bytes of the sample, and cells made of it.
SAMPLE_ROWS, SAMPLE_BYTES, CELLS = 2_048, 16 << 20, 32
#: Bits of a quantised query coordinate.
QUERY_BITS = 4
#: Confidence of the error bound, in standard deviations.
EPSILON = 3.0


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix that depends on the dimension and seed only."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    width = -flags.shape[1] % 64
    padded = np.pad(flags, ((0, 0), (0, width)))
    return np.packbits(padded, axis=1).view(np.uint64)


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; components are scaled first, so tiny and huge ones survive."""
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    # in two steps: a power of two near the largest component may itself have no inverse
    scaled = np.ldexp(vectors, -np.frexp(scale)[1])
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / length, np.ldexp(length[:, 0], np.frexp(scale)[1][:, 0])


class Codes:
    """One-bit codes of rows with their correction scalars."""

    def __init__(self, unit: np.ndarray, norm: np.ndarray, turn: np.ndarray) -> None:
        dimension = unit.shape[1]
        self.norm = norm
        turned = unit @ turn.T
        positive = turned > 0
        self.bits = pack_bits(positive)
        self.ones = positive.sum(axis=1)
        self.fit = np.abs(turned).sum(axis=1) / np.sqrt(dimension)  # <code, direction>
        self.spread = np.sqrt(np.maximum(1 - self.fit**2, 0) / (self.fit**2 * max(dimension - 1, 1)))


class Query:
    """Queries turned and quantised to bit planes."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray) -> None:
        self.vectors = vectors
        self.unit, self.norm = directions(vectors)
        turned = self.unit @ turn.T
        self.low = turned.min(axis=1)
        top = (1 << QUERY_BITS) - 1
        self.step = np.maximum((turned.max(axis=1) - self.low) / top, 1e-12)
        levels = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.int64)
        self.planes = [pack_bits((levels >> b) & 1 == 1) for b in range(QUERY_BITS)]
        self.level_sum = levels.sum(axis=1)
        self.rounding = self.step / np.sqrt(12)  # deviation of a coordinate's rounding


def estimate(query: Query, rows: np.ndarray, codes: Codes, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of some queries and all codes (with high
    probability); none where the product of the lengths leaves the range of doubles."""
    dot = np.zeros((len(query.norm[rows]), len(codes.norm)))
    for b, plane in enumerate(query.planes):
        own = plane[rows]
        common = np.zeros(dot.shape, dtype=np.int64)
        for w in range(own.shape[1]):
            common += np.bitwise_count(own[:, w, None] & codes.bits[None, :, w])
        dot += common << b
    step, low = query.step[rows, None], query.low[rows, None]
    root = np.sqrt(dimension)
    # <code, q> with code = (2 bits - 1) / sqrt(D) and q = low + step * levels
    inner = (2 * step * dot + 2 * low * codes.ones[None, :] - step * query.level_sum[rows, None] - low * dimension) / root
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        scale = query.norm[rows, None] * codes.norm[None, :]
        near, error = inner / codes.fit[None, :], EPSILON * np.sqrt(codes.spread[None, :] ** 2 + (query.rounding[rows, None] / codes.fit[None, :]) ** 2)
        fine = (scale > 1e-280) & (scale < 1e280)
        return np.where(fine, scale * (near - error), -np.inf), np.where(fine, scale * (near + error), np.inf)


class Best:
    """The k best (score, id) of each query so far: largest score, then smallest id. Sums that
    are not a number (infinite products of both signs) count as the largest, as in SQL.

    Rows are held as they come and sorted out together, once they are twice as many as can stay
    or ``PAIRS_HELD`` more."""

    def __init__(self, queries: int, k: int) -> None:
        self.queries, self.k = queries, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> bool:
        """Whether the rows held were sorted out."""
        self.parts.append((q, scores, ids))
        self.held += len(q)
        if self.held <= self.queries * self.k + min(self.queries * self.k, PAIRS_HELD):
            return False
        self.sorted_out()
        return True

    def sorted_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, scores and ids of the rows that stay, each query's best first."""
        q, s, i = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int64, np.float64, np.int64), zip(*self.parts, strict=True) if self.parts else ((), (), ()), strict=True))
        odd = np.isnan(s)
        order = np.lexsort((i, -np.where(odd, 0, s), ~odd, q))
        q = q[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.parts = [(q[keep], s[order][keep], i[order][keep])]
        self.held = int(keep.sum())
        return self.parts[0]

    def floors(self) -> tuple[np.ndarray, np.ndarray]:
        """The queries that have k rows, after these were sorted out, and the score of the k-th."""
        q, s, _ = self.parts[0]
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        return q[last], s[last]


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the coordinates: of one query
    with all rows, or of each query with the row at its place."""
    total = np.zeros(len(rows))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for j in range(rows.shape[1]):
            total += rows[:, j] * queries[..., j]
    return total


def bounded(query: Query, some: np.ndarray, rows: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products from a block product, whose order of summation is
    not fixed; none where the product of the lengths leaves the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        scale = query.norm[some, None] * norm[None, :]
        near = query.vectors[some] @ rows.T
        fine = (scale > 1e-280) & (scale < 1e280)
        return np.where(fine, near - 1e-9 * scale, -np.inf), np.where(fine, near + 1e-9 * scale, np.inf)


def cell_centres(unit: np.ndarray, cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Directions of up to ``cells`` clusters of a sample of directions."""
    centres = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)] if len(unit) else unit
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1) if len(unit) else np.zeros(0, dtype=int)
        for c in range(len(centres)):
            total = unit[own == c].sum(axis=0)
            if np.linalg.norm(total) > 0:
                centres[c] = total / np.linalg.norm(total)
    return centres


def first_floors(ids: np.ndarray, unit: np.ndarray, norm: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th best inner product: the k-th best among the sample."""
    floors = np.full(len(ids), -np.inf)
    if len(sample_ids) > k:
        sample_unit, sample_norm = directions(sample)
        for a in range(0, len(ids), QUERY_BLOCK):
            some = slice(a, a + QUERY_BLOCK)
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                scale = norm[some, None] * sample_norm[None, :]
                low = scale * (unit[some] @ sample_unit.T - 1e-9)
            low = np.where((scale > 1e-280) & (scale < 1e280) & (ids[some, None] != sample_ids[None, :]), low, -np.inf)
            floors[some] = np.partition(low, -k, axis=1)[:, -k]
    return floors


def usable(ids: pa.Array, vectors: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and double vectors that are whole: not null, of the dimension, finite, not zero."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    valid = np.array(vectors.is_valid()) & np.array(ids.is_valid())
    sizes = np.array(vectors.value_lengths().fill_null(-1))
    if dimension is None:
        dimension = int(np.bincount(sizes[valid & (sizes > 0)]).argmax()) if (valid & (sizes > 0)).any() else 0
    at = np.flatnonzero(valid & (sizes == dimension))
    flat = vectors.take(pa.array(at)).flatten()
    matrix = np.array(flat.fill_null(np.nan), dtype=np.float64).reshape(len(at), dimension)
    fine = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return np.array(ids.take(pa.array(at)))[fine], matrix[fine]


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES, codes: bool = True) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score`` of each query's nearest rows.

    A row is no candidate of a query with its own id. Nearness is the inner product of the
    original vectors in double precision; ties go to the smaller id. Null vectors, vectors of
    another dimension than the queries' commonest, zero vectors and those with null or
    non-finite components take no part, neither do null ids; any other length does, however
    small or large. Fewer than ``k`` candidates are all returned; no queries or rows give an
    empty result; other columns are not read. Queries with equal ids and repeated rows are each
    answered or found as they are. Without ``codes`` all rows of the cells that can matter are
    compared exactly.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    data = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sizes = asked.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").collect()
    dimension = sizes[0]["size"] if sizes else 0
    chunks = max(1, -(-sum(r["n"] for r in sizes) * (8 * max(r["size"] for r in sizes) + 16) // query_bytes)) if sizes and dimension else 0
    schema = "query_id long, id long, score double"
    parts, sample = [], None
    for c in range(chunks):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).toArrow()
        ids, vectors = usable(got.column(0).combine_chunks(), got.column(1).combine_chunks(), dimension) if got.num_rows else (np.zeros(0, np.int64), np.zeros((0, dimension)))
        if len(ids) == 0:
            continue
        if sample is None:
            first = data.where(F.size("v") == dimension).orderBy(F.xxhash64("id"), "id", "v").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dimension)))).toArrow()
            sample = usable(first.column(0).combine_chunks(), first.column(1).combine_chunks(), dimension) if first.num_rows else (np.zeros(0, np.int64), np.zeros((0, dimension)))
            centres = cell_centres(directions(sample[1])[0])
        floors = first_floors(ids, *directions(vectors), *sample, k)
        shared = table.sparkSession.sparkContext.broadcast((ids, vectors, floors, centres))
        parts.append(data.mapInArrow(_scan(shared, dimension, k, codes), schema))
    if not parts:
        return table.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _scan(shared, dimension: int, k: int, use_codes: bool):
    """Per task: the k best rows for each query of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, floors, centres = shared.value
        turn = rotation(dimension)
        query, best = Query(vectors, turn), Best(len(query_ids), k)
        pairs = max(1, PAIR_VALUES // dimension)
        floors = floors.copy()
        toward = np.arccos(np.clip(query.unit @ centres.T, -1, 1)) if len(centres) else None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def compare(ids: np.ndarray, rows: np.ndarray, unit: np.ndarray, norm: np.ndarray, asked: np.ndarray) -> None:
            codes = Codes(unit, norm, turn) if use_codes else None
            for a in range(0, len(asked), QUERY_BLOCK):
                some = asked[a : a + QUERY_BLOCK]
                other = ids[None, :] != query_ids[some, None]
                if codes is None:
                    worth = other
                else:
                    worth = other & ~(estimate(query, some, codes, dimension)[1] < floors[some, None])
                # what the codes leave is reranked as a block, and summed in order if it can enter
                at_q, at_r = np.flatnonzero(worth.any(axis=1)), np.flatnonzero(worth.any(axis=0))
                if not len(at_q):
                    continue
                some, worth = some[at_q], worth[np.ix_(at_q, at_r)]
                low, high = bounded(query, some, rows[at_r], norm[at_r])
                if len(at_r) > k:
                    least = np.partition(np.where(worth, low, -np.inf), -k, axis=1)[:, -k]
                    floors[some] = np.maximum(floors[some], least)
                i, j = np.nonzero(worth & ~(high < floors[some, None]))
                for x in range(0, len(i), pairs):
                    q, r = some[i[x : x + pairs]], at_r[j[x : x + pairs]]
                    if best.add(q, exact(vectors[q], rows[r]), ids[r]):
                        full, score = best.floors()
                        floors[full] = np.fmax(floors[full], score)

        def by_cell() -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            unit, norm = directions(rows)
            own = (unit @ centres.T).argmax(axis=1) if toward is not None else np.zeros(len(ids), dtype=int)
            for c in np.unique(own).tolist():
                members = np.flatnonzero(own == c)
                asked = np.arange(len(query_ids))
                if toward is not None:
                    width = np.arccos(np.clip(unit[members] @ centres[c], -1, 1)).max() + 1e-6
                    cosine = np.cos(np.maximum(toward[:, c] - width, 0)) + 1e-9
                    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                        length = np.where(cosine > 0, norm[members].max(), norm[members].min())
                        reach = query.norm * length * cosine
                    asked = asked[~((reach < floors) & (query.norm * length > 1e-280))]
                for a in range(0, len(members), ROW_BLOCK):
                    at = members[a : a + ROW_BLOCK]
                    compare(ids[at], rows[at], unit[at], norm[at], asked)
            held.clear()

        count = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                ids, rows = usable(part.column(0), part.column(1), dimension)
                if len(ids):
                    held.append((ids, rows))
                    count += len(ids)
                if count >= HELD_ROWS:
                    by_cell()
                    count = 0
        if held:
            by_cell()
        q, scores, found = best.sorted_out()
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(found), pa.array(scores)], names=["query_id", "id", "score"])

    return run


def oracle(k: int = 20) -> str:
    """The exact neighbours of every row whose id is divisible by 20, as DuckDB SQL."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""
