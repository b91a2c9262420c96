"""Centroid clustering (Lloyd's rounds) over Hilbert-ordered vector blocks with zone maps.

Components become integers, so distances, sums and means are exact and results do not depend on how
rows are dealt.

1. Every vector gets the index of its cell on a Hilbert curve over all components (``bits`` leading bits
   each). A range partitioning by that index and a sort inside the partitions put near vectors side by
   side; runs of ``rows`` of them are stored as one *block* with its zone map, the least and greatest
   value of each component.
2. Of a block only the box is compared with all centroids: no vector of it is nearer to a centroid than
   the box is, nor farther than the box's far corner. A centroid that is farther from the box than some
   other centroid's far corner cannot win in it. Vectors are compared with the remaining candidates only,
   all at once, as a product of matrices.
3. A round returns one row of sums per task and cluster; the centroids, a fixed number of vectors, are
   all the driver holds.

Defined results: vectors that are null, of another length or hold null or non-finite components are left
out; repeated rows are vectors of their own; a vector without id is clustered but starts no centroid while
others can; equal hashes start in order of their vectors; with fewer vectors than centroids there are as
many centroids as vectors; an empty table gives no rows; extra columns are ignored, whatever their names.
Components of any size are exact (beyond 2**21 in Python integers); a distance that does not fit a long is
an error, never a wrapped number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.session import staged

_DOUBLE = 1 << 21  #: up to this size products of 64 components are exact in doubles
_LONG = 1 << 27  #: up to this size their distances fit 64 bits


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64  #: components become floor(scale * x)
    seed: int = 1
    bits: int = 4  #: leading bits of a component that the curve sees
    rows: int = 256  #: vectors of a block


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place on the Hilbert curve of each row of ``cells`` (row by dimension, below 2**bits), as bytes that
    sort alike. Skilling's transform: undo the excess reflections, then Gray-decode."""
    x = cells.T.astype(np.uint32)
    dims = len(x)
    q = 1 << bits - 1
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(dims):
            on = x[i] & np.uint32(q) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << bits - 1
    while q > 1:
        flip ^= np.where(x[-1] & np.uint32(q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = [(x >> np.uint32(b) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.packbits(np.concatenate(planes).T, axis=1)]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 or, where that is too small, as Python integers."""
    scaled = np.floor(values * float(scale))
    if np.abs(scaled).max(initial=0) < _LONG:
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():
        raise OverflowError("a scaled component is no double")
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vector by centroid."""
    size = max(int(np.abs(x).max()) if x.size else 0 for x in (vectors, centroids))
    if size < _DOUBLE:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    kind = np.int64 if size < _LONG else object
    return np.stack([((vectors.astype(kind) - c.astype(kind)) ** 2).sum(1) for c in centroids], 1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids, in ascending order, that may be nearest to a vector of the box; ties included."""
    kind = np.int64 if max(int(np.abs(x).max()) for x in (low, high, centroids)) < _LONG else object
    low, high, c = low.astype(kind), high.astype(kind), centroids.astype(kind)
    under, over = low - c, c - high
    outside = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(c - low), np.abs(c - high))
    return np.flatnonzero((outside * outside).sum(1) <= (far * far).sum(1).min())


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of a block's vectors; ties go to the smaller number."""
    own = candidates(low, high, centroids)
    found = distances(vectors, centroids[own])
    best = found.argmin(1)
    return own[best], found[np.arange(len(vectors)), best]


def _pack(m: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a number, numbers) in the narrowest of 2, 4, 8 and 152 bytes; the last holds any double."""
    size = int(np.abs(m).max()) if m.size else 0
    for width in (2, 4, 8):
        if size < 1 << 8 * width - 2:
            return width, m.astype(f"<i{width}").tobytes()
    return 152, b"".join(int(x).to_bytes(152, "little", signed=True) for x in m.ravel())


def _unpack(width: int, data: bytes, dims: int) -> np.ndarray:
    if width <= 8:
        return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dims)
    return np.array([int.from_bytes(data[i:i + width], "little", signed=True) for i in range(0, len(data), width)], object).reshape(-1, dims)


def _clean(vectors: DataFrame, config: ClusterConfig, vec_id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == config.dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def blocks(vectors: DataFrame, config: ClusterConfig = ClusterConfig(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Stored blocks (ids, width, v, low, high) of the vectors in Hilbert order."""
    clean = _clean(vectors, config, vec_id, embedding)
    # The curve's cells span the middle of the data: mean and spread of all components together.
    span = clean.select(F.explode("v").alias("x")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).first()
    mean, spread = span.mean or 0.0, span.spread or 1.0
    levels = 1 << config.bits

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), config.dims)
            place = np.nan_to_num((m - mean) / spread * levels / 4 + levels / 2)
            keys = hilbert_keys(np.clip(place, 0, levels - 1).astype(np.uint32), config.bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["vec_id", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = integers(_matrix(batch.column(1), config.dims), config.scale)
            rows = []
            for i in range(0, len(m), config.rows):
                part = m[i:i + config.rows]
                low, high = part.min(0), part.max(0)
                width, packed = _pack(part)
                edge, box = _pack(np.stack([low, high]))
                rows.append((batch.column(0)[i:i + config.rows].to_pylist(), width, packed, edge, box))
            ids, width, packed, edge, box = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.list_(pa.int64())), pa.array(width, pa.int32()), pa.array(packed, pa.binary()), pa.array(edge, pa.int32()), pa.array(box, pa.binary())],
                names=["ids", "width", "v", "edge", "box"])

    # Copies share a place; the id spreads them over partitions.
    near = clean.mapInArrow(keyed, "vec_id long, v array<double>, place binary").repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    return staged(near.select("vec_id", "v").mapInArrow(cut, "ids array<long>, width int, v binary, edge int, box binary"), "blocks")


def _opened(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, width, v, edge, box in zip(*(batch.column(k) for k in range(5)), strict=True):
            corner = _unpack(edge.as_py(), box.as_py(), dims)
            yield ids.values, _unpack(width.as_py(), v.as_py(), dims), corner[0], corner[1]


def starts(vectors: DataFrame, config: ClusterConfig = ClusterConfig(), vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """The vectors whose seeded ids have the least hashes, in the order of these."""
    hashed = _clean(vectors, config, vec_id, embedding).withColumn("h", F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(config.k).collect()
    return integers(np.array([r.v for r in first], np.float64).reshape(-1, config.dims), config.scale)


def totals(stored: DataFrame, centroids: np.ndarray, config: ClusterConfig = ClusterConfig()) -> dict[int, tuple[int, list[int], int]]:
    """Cluster to (vectors, sums of their components, sum of their squared distances)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia = [0] * len(centroids), [0] * len(centroids)
        sums = np.zeros((len(centroids), config.dims), object)
        for _, v, low, high in _opened(batches, config.dims):
            cluster, distance = nearest(v, low, high, centroids)
            for c in np.unique(cluster).tolist():
                on = cluster == c
                count[c] += int(on.sum())
                sums[c] += v[on].sum(0).astype(object)
                inertia[c] += int(distance[on].astype(object).sum())
        own = [c for c, n in enumerate(count) if n]
        number = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array([count[c] for c in own], pa.int64()),
             pa.array([[Decimal(int(x)) for x in sums[c]] for c in own], pa.list_(number)), pa.array([Decimal(inertia[c]) for c in own], number)],
            names=["cluster", "n", "sums", "inertia"])

    parts = stored.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>, inertia decimal(38,0)")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(config.dims)]).alias("sums"),
                                         F.sum("inertia").alias("inertia"))
    return {r.cluster: (r.n, [int(x) for x in r.sums], int(r.inertia)) for r in whole.collect()}


def fit(stored: DataFrame, centroids: np.ndarray, config: ClusterConfig = ClusterConfig()) -> np.ndarray:
    """The centroids after ``rounds`` rounds; one without vectors stays where it is."""
    for _ in range(config.rounds):
        found = totals(stored, centroids, config)
        rows = [[s // found[c][0] for s in found[c][1]] if c in found else [int(x) for x in row] for c, row in enumerate(centroids)]
        wide = max((abs(x) for row in rows for x in row), default=0) >= 1 << 62
        centroids = np.array(rows, object if wide else np.int64).reshape(-1, config.dims)
    return centroids


def cluster(vectors: DataFrame, config: ClusterConfig = ClusterConfig(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    stored = blocks(vectors, config, vec_id, embedding)
    centroids = fit(stored, starts(vectors, config, vec_id, embedding), config)
    found = totals(stored, centroids, config)
    own = {c: x[2] for c, x in found.items()}
    every = sum(own.values())
    digest = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, low, high in _opened(batches, config.dims):
            number, distance = nearest(v, low, high, centroids)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.int64()), pa.array([own[c] for c in number.tolist()], pa.int64()),
                 pa.array([every] * n, pa.int64()), pa.array([digest[c] for c in number.tolist()], pa.string())],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
