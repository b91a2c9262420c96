"""Target-distribution importance resampling over hashed word n-grams.

Documents are weighed by how much likelier their words are in a target corpus than in the source, and a
share of them is drawn without replacement by the Gumbel-top-k rule.

1. *Batch concatenation.* The texts of a part are joined with a separator byte that UTF-8 never holds;
   one regex pass returns words and separators in order. The places of the separators are the document
   offsets: a binary search over them gives every word its document, and an n-gram whose first and last
   word lie in different documents is masked. What is left is counted with ``bincount``.
2. Buckets are CRC-32 remainders. Only distinct words are run through CRC-32; the checksum of an n-gram
   is put together from those of its words (appending n bytes is a linear map of the checksum).
3. A task sends one number per bucket; an aggregate adds them up. The driver sees ``buckets`` numbers and
   sends as many gains back, whatever the size of the input.
4. A draw ranks by score without a global sort: scores are integers, so a histogram of them (bounded by
   their range) gives every score its first rank, and rows are numbered inside one score only.

Defined results: a null text has no words, hence no features and weight 0, and is not drawn; a null
doc_id is hashed as an empty id and comes first among ties; repeated rows get a rank each; an empty
target or source counts as empty (all gains come from the smoothing); an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.llm import arrays
from tapeframe.session import staged

_SEPARATOR = b"\xff"
_TOKENS = re.compile(rb"\xff|[^\x00-\x2f\x3a-\x60\x7b-\x7f\xff]+")


@dataclass(frozen=True)
class ResampleConfig:
    n: int = 2  #: words of the longest feature
    buckets: int = 10_000
    scale: int = 1000  #: gains and scores are integers, this many to one nat
    min_words: int = 20  #: a shorter document is weighed but never drawn
    percent: int = 25  #: of the eligible documents that are drawn
    seed: int = 7


def _zero_step(x: np.ndarray) -> np.ndarray:
    """The CRC register after one more zero byte."""
    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    return byte[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _shift_tables(levels: int = 31) -> list[np.ndarray]:
    """Table k maps each byte of a register to the register after 2**k zero bytes."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image, tables = _zero_step(units), []
    for _ in range(levels):
        table = np.zeros((4, 256), np.uint32)
        for b in range(32):
            table[b // 8] ^= np.where(np.arange(256) >> b % 8 & 1, image[b], 0).astype(np.uint32)
        tables.append(table)
        image = _through(table, image)
    return tables


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


_SHIFTS: list[np.ndarray] = []


def append_crc(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from those of a and b and the length of b, elementwise."""
    if not _SHIFTS:
        _SHIFTS.extend(_shift_tables())
    out = left.copy()
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        on = np.flatnonzero(size >> k & 1)
        out[on] = _through(_SHIFTS[k], out[on])
    return out ^ right


def features(texts: list[bytes], config: ResampleConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of 1 to ``n`` words of lower-cased texts, and words per document."""
    joined = _SEPARATOR.join(texts)
    tokens = pa.array(_TOKENS.findall(joined), pa.binary()).dictionary_encode()
    code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = tokens.dictionary.to_pylist()
    offsets = np.flatnonzero(code == known.index(_SEPARATOR)) if len(texts) > 1 else code[:0]
    word = np.ones(len(code), bool)
    word[offsets] = False
    owner = np.searchsorted(offsets, np.flatnonzero(word), "right")
    code = code[word]
    crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))
    size = np.fromiter(map(len, known), np.int64, len(known)) + 1
    docs, buckets, now = [owner], [crc[code] % config.buckets], crc[code]
    for k in range(1, config.n):
        now = append_crc(now[:-1], spaced[code[k:]], size[code[k:]])
        inside = owner[:len(now)] == owner[k:]
        docs.append(owner[:len(now)][inside])
        buckets.append(now[inside] % config.buckets)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64), np.bincount(owner, minlength=len(texts))


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in arrays.parts(batches, column):
        texts = arrays.plain_texts(batch.column(column))
        for i, j in arrays.slices(texts):
            # bytes.lower() changes A-Z only
            yield batch.slice(i, j - i), [x.lower() for x in texts[i:j].cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, config: ResampleConfig = ResampleConfig(), text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, np.int64)
        for _, texts in _batches(batches, 0):
            total += np.bincount(features(texts, config)[1], minlength=config.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
    out = np.zeros(config.buckets, np.int64)
    for r in rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, config: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """The integer log ratio of smoothed target and source shares of each bucket."""
    s_all, t_all = int(source.sum()) + config.buckets, int(target.sum()) + config.buckets
    return np.array([math.floor(config.scale * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
                    np.int64)


def weights(docs: DataFrame, gain: np.ndarray, config: ResampleConfig = ResampleConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain over a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(batches, 1):
            owner, bucket, words = features(texts, config)
            # Sums of integers below 2**53 are exact in doubles.
            total = np.bincount(owner, gain[bucket], len(texts)).astype(np.int64)
            n = np.bincount(owner, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise(config: ResampleConfig) -> F.Column:
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-config.scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """``weighed`` with score, the weight plus Gumbel noise that depends on the doc_id alone, and rank: 1, 2, ...
    for the drawn rows, null for the others."""
    rows = staged(weighed.withColumn("score", F.col("weight") + _noise(config)), "scores")
    able = F.col("n_words") >= config.min_words
    # One row per integer score: their range is that of log ratios of counts, some tens of thousands.
    histogram = sorted(rows.where(able).groupBy("score").count().collect(), key=lambda r: -r.score)
    drawn, ahead, first = config.percent * sum(r["count"] for r in histogram) // 100, 0, []
    for r in histogram:
        if ahead >= drawn:
            break
        first.append((r.score, ahead))
        ahead += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(first, "score long, ahead long"))
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id")))
    reached = rows.where(able).join(starts, "score").withColumn("rank", F.col("ahead") + inside)
    reached = reached.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    least = first[-1][0] if first else None
    rest = rows.where(~able | (F.col("score") < least)) if first else rows
    names = [*rows.columns, "rank"]
    return reached.select(names).unionAll(rest.withColumn("rank", F.lit(None).cast("long")).select(names))


def resample(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig(), doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank: every document with its chance and place in the draw."""
    gain = gains(bucket_counts(docs, config, text), bucket_counts(target, config, target_text), config)
    return draw(weights(docs, gain, config, doc_id, text), config)
