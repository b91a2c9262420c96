"""Numpy helpers shared by the text operators: everything here works on one Arrow batch in a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that numpy temporaries are sized for; a longer single text is taken alone.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LONG_WORD = 1 << 16
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, tag: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values; ``tag`` separates uses."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(tag))


def free_name(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_texts(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """The column as one string array; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n + 1) of a large_string array without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw[:0], (at - at[0] if len(at) else np.zeros(1, np.int64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; a longer text is a range of its own."""
    if not len(texts):
        return
    _, at = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def parts(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes of the text column, so that copies stay small."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


#: Byte classes: letters and digits of ASCII plus all bytes of other characters; ASCII white space.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every maximal run of bytes for which ``inside`` holds, never across rows."""
    on = inside[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    edges = at[(at > 0) & (at < len(raw))]
    first[edges] = on[edges]
    last[edges - 1] = on[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hashes of the spans; they depend on the spans' bytes alone."""
    out = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(end - start <= _LONG_WORD)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(short):
            lo = start[short[i]]
            j = max(i + 1, int(np.searchsorted(end[short], lo + SLICE_BYTES, "right")))
            own = short[i:j]
            s, e = start[own] - lo, end[own] - lo
            power, inverse = _powers(int(e[-1]) + 1)
            total = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum((raw[lo:lo + e[-1]].astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
            out[own] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
        for k in np.flatnonzero(end - start > _LONG_WORD):
            digest = hashlib.blake2b(raw[start[k]:end[k]].tobytes(), digest_size=8).digest()
            out[k] = int.from_bytes(digest, "little")
    return out


def merge_sums(df: DataFrame, keys: list[str], shards: int = 64) -> DataFrame:
    """Add up float64 vectors (binary column ``v``) per key, in two levels so that no task gathers
    the vectors of all partitions of a key. ``df`` has the keys, ``shard`` (int) and ``v``."""
    names = [f.name for f in df.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("v"):
            x = np.frombuffer(v.as_buffer(), np.float64)
            total = x.copy() if total is None else total + x
        first = {n: pa.array([table.column(n)[0].as_py()], table.schema.field(n).type) for n in names}
        return pa.table(first | {"v": pa.array([total.tobytes()], pa.binary())})

    def level(x: DataFrame, by: list, schema: str) -> DataFrame:
        return x.groupBy(*by).applyInArrow(add, schema)

    part = df.withColumn("shard", F.expr(f"cast(pmod(shard, {shards}) as int)"))
    names = [*names, "shard"]
    part = level(part, [F.col(n) for n in names], ", ".join([x for x in (schema, "shard int, v binary") if x]))

    def final(table: pa.Table) -> pa.Table:
        return add(table).drop(["shard"])

    by = [F.col(n) for n in names[:-1]] or [F.lit(0).alias("one")]
    return part.groupBy(*by).applyInArrow(final, ", ".join([x for x in (schema, "v binary") if x]))
