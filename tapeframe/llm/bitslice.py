"""Exact top-k search by inner product over a bit-sliced index.

Vectors are turned into integers. The rows of a cell keep, for each component, bit slices of the
component's leading bits: slice b is a bitmap with bit b of every row. For a query the slices are added
up, each component weighted by the query's value, with bitmap arithmetic (full adders on words of 64
rows), which gives slices of an approximate score that is never above the exact one and short of it by
at most a bound. From the most significant slice downward the k-th largest approximate score is found;
all rows within the bound of it, the boundary, are scored exactly, so the result is exact.

Queries and rows meet in a grid: rows are dealt over row cells, queries over query cells, and a task
holds one of each, both of bounded size; there are at least as many pairs of cells as cores, if there are
queries enough. Each returns the best k of a query in its cell.

Defined results: a vector that is null or holds a null or a value that is not finite takes no part;
neither does a row without id. Vectors of other length than the query's are no candidates for it. Rows that
repeat an id are rows of their own, as queries and as candidates. Fewer candidates than k give all; an empty
table gives no rows; extra columns are ignored. Components of any size are exact (in Python integers, where
64 bits do not hold a sum); a score among the best that does not fit a long is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.session import staged


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    scale: int = 1024  #: components become floor(scale * x)
    slices: int = 6  #: leading bits of a component that are indexed
    cell_bytes: int = 1 << 24  #: of the vectors of a row cell, at 8 bytes a component
    queries: int = 1 << 11  #: queries of a query cell at most


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 or, where that is too small, as Python integers."""
    scaled = np.floor(values * float(scale))
    if np.abs(scaled).max(initial=0) < 1 << 61:
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():
        raise OverflowError("a scaled component is no double")
    return np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


class Cell:
    """The index of some vectors of equal length; ``ids`` are row numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, config: SearchConfig, order: np.ndarray | None = None):
        self.config, self.ids, self.vectors = config, ids, vectors
        self.order = (ids if order is None else order).tolist()  # of rows with equal scores
        n, self.dims = vectors.shape
        self.most = int(np.abs(vectors).max()) if vectors.size else 0
        self.low = int(vectors.min()) if vectors.size else 0
        bits = max(1, (int(vectors.max()) - self.low if vectors.size else 0).bit_length())
        self.shift = max(0, bits - config.slices)
        self.bits = min(bits, config.slices)
        self.words = -(-n // 64)
        lead = (vectors - self.low >> self.shift).astype(np.uint8)
        padded = np.zeros((self.words * 64, self.dims), np.uint8)
        padded[:n] = lead
        # [component, bit, word]
        self.slices = np.stack([np.packbits(padded >> b & 1, axis=0, bitorder="little").T.copy().view(np.uint64) for b in range(self.bits)], 1)
        self.alive = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)
        self.flipped = ~self.slices

    def approximate(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over components of |q| times the leading bits,
        which are complemented where q is negative."""
        total: list[np.ndarray] = []
        for d in range(self.dims):
            weight = abs(int(query[d]))
            part = self.slices[d] if query[d] > 0 else self.flipped[d]
            while weight:
                low = (weight & -weight).bit_length() - 1
                weight &= weight - 1
                add(total, part, low)
        return total

    def search(self, query: np.ndarray, own: int) -> list[tuple[int, int]]:
        """(score, place in the cell) of the best k rows other than ``own``."""
        k = self.config.k
        among = self.alive
        mine = np.flatnonzero(self.ids == own)
        if len(mine):
            among = among.copy()
            for i in mine.tolist():
                among[i >> 6] &= ~np.uint64(1 << (i & 63))
        total = self.approximate(query)
        least = kth_largest(total, among, k)
        # A row's exact score minus its approximate one lies between 0 and this, after a common shift.
        size = sum(abs(int(x)) for x in query)
        slack = size * ((1 << self.shift) - 1)
        boundary = at_least(total, among, least - (-(-slack >> self.shift)))
        rows = np.flatnonzero(np.unpackbits(boundary.view(np.uint8), bitorder="little"))
        near = self.vectors[rows]
        scores = (near @ query if size * self.most < 1 << 63 else near.astype(object) @ query.astype(object)).tolist()
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], self.order[rows[i]]))[:k]
        return [(scores[i], int(rows[i])) for i in best]


def add(total: list[np.ndarray], part: np.ndarray, at: int) -> None:
    """Add the number in the slices of ``part``, moved up by ``at`` bits, to the slices of ``total``."""
    zero = np.zeros_like(part[0])
    while len(total) < at:
        total.append(zero)
    carry = None
    for b, x in enumerate(part):
        if at + b == len(total):
            total.append(x.copy() if carry is None else x ^ carry)
            carry = None if carry is None else x & carry
            continue
        y = total[at + b]
        half = x ^ y
        if carry is None:
            total[at + b], carry = half, x & y
        else:
            total[at + b], carry = half ^ carry, (x & y) | (half & carry)
    b = at + len(part)
    while carry is not None and carry.any():
        if b == len(total):
            total.append(carry)
            break
        total[b], carry = total[b] ^ carry, total[b] & carry
        b += 1


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_largest(total: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th largest number (the least, if there are fewer rows), bit by bit from the top slice."""
    value, ahead, tied = 0, 0, among
    for b in range(len(total) - 1, -1, -1):
        ones = tied & total[b]
        n = count(ones)
        if ahead + n >= k:
            tied, value = ones, value | 1 << b
        else:
            ahead += n
            tied = tied & ~total[b]
    return value if ahead + count(tied) >= k else 0


def at_least(total: list[np.ndarray], among: np.ndarray, bound: int) -> np.ndarray:
    """The rows whose number is ``bound`` or more, from the top slice downward."""
    if bound <= 0:
        return among
    above, tied = np.zeros_like(among), among
    for b in range(max(len(total), bound.bit_length()) - 1, -1, -1):
        x = total[b] if b < len(total) else np.zeros_like(among)
        if bound >> b & 1:
            tied = tied & x
        else:
            above = above | (tied & x)
            tied = tied & ~x
    return above | tied


def top_k(vectors: DataFrame, is_query: F.Column, config: SearchConfig = SearchConfig(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of largest score for every query row.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id.
    """
    clean = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
             .where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    # Stored, so that the row numbers stay the same for all readers.
    rows = staged(clean.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dims"), "v"), "vectors")
    asked = rows.where(is_query)
    n, m, dims = rows.agg(F.count("*"), F.count_if(is_query), F.max("dims")).first()
    across = max(1, -(-n * max(dims or 1, 1) * 8 // config.cell_bytes))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-m // config.queries), min(-(-cores // across), m // 16))
    deal = lambda cells: F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")
    left = rows.select("dims", "row", "vec_id", "v", deal(across).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("c"))
    right = asked.select("dims", "row", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("r"), deal(down).alias("c"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = table.column("row").to_numpy()
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return row, table.column("vec_id").to_numpy(), integers(values.reshape(len(row), -1), config.scale)

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(candidates) and len(queries):
            row, ids, v = matrix(candidates)
            cell = Cell(row, v, config, ids)
            for own, query_id, query in zip(*matrix(queries), strict=True):
                out += [(int(own), int(query_id), int(ids[i]), s) for s, i in cell.search(query, own)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        # A score beyond 64 bits stops here with an error.
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_row", "query_id", "vec_id", "score"), columns, strict=True)})

    keys = ["dims", "r", "c"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")
