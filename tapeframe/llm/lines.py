"""Line deduplication: winnowed line fingerprints, joined and extended, later repeated runs deleted.

A document is the sequence of its lines, trimmed, without blank ones. A *run* is a stretch of
consecutive lines of ``min_words`` words or more. Lines are windowed by words: for every line the
shortest run that starts there and the shortest that ends there. In each window the line of least hash
is the fingerprint, so equal windows have equal fingerprints at equal places, and any repeated run holds
a window, hence a fingerprint, in every copy.

Positions are joined on the fingerprint together with its context, the lines of the window to both
sides. That extends a match both ways before rows are joined, so a line that occurs everywhere does not
pair with its every copy: each copy meets only the first window of equal content, which one
pre-aggregated row stands for. The union of a document's matched windows is every maximal extension.

A line is deleted if it lies in a run that occurred earlier, in the order of doc_id and line. The
first occurrence always stays.

Defined results: a null text stays null and an empty one empty; repeated rows (equal doc_id and text)
are one document, each row gets the same result; a null doc_id comes before all others; an empty table
gives no rows; blank lines are kept; ``deduplicate`` takes its columns by name and ignores others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm import arrays
from tapeframe.session import staged

MIN_WORDS = 50

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def windows(lines: list[str], min_words: int) -> tuple[np.ndarray, ...]:
    """(fingerprint, context high, context low, first, last) of a document's windows; positions count
    all lines, blank ones included."""
    place = [i for i, x in enumerate(lines) if x and not x.isspace()]
    own = [lines[i].strip() for i in place]
    total = np.concatenate([[0], np.cumsum([len(x.split()) for x in own])])
    n = len(own)
    index = np.arange(n)
    last = np.searchsorted(total, total[:-1] + min_words, "left") - 1
    first = np.searchsorted(total, total[1:] - min_words, "right") - 1
    forward, backward = last < n, first >= 0
    both = np.unique(np.concatenate([index[forward] * (n + 1) + last[forward], first[backward] * (n + 1) + index[backward]]))
    lo, hi = both // (n + 1), both % (n + 1)
    if not len(lo):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode()) for x in own]), np.uint64).reshape(n, 2)
    with np.errstate(over="ignore"):
        sums = np.zeros((n + 1, 2), np.uint64)
        np.cumsum(arrays.mix(digest) * _powers(_B, n)[:, None], axis=0, out=sums[1:])
        context = arrays.mix((sums[hi + 1] - sums[lo]) * _powers(_B_INVERSE, n)[lo][:, None] + (hi - lo + 1).astype(np.uint64)[:, None])
    pairs = np.column_stack([lo, hi + 1]).ravel()  # the odd results, between windows, are not used
    least = np.minimum.reduceat(np.append(digest[:, 0], np.uint64(0)), pairs)[::2]
    at = np.array(place)
    return least.view(np.int64), context[:, 0].copy().view(np.int64), context[:, 1].copy().view(np.int64), at[lo], at[hi]


def line_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows of every document (doc_id long, text_key long, text): one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, 2):
            texts = arrays.plain_texts(batch.column(2))
            for i, j in arrays.slices(texts):
                row, parts = [], []
                for k, t in enumerate(texts[i:j].to_pylist()):
                    found = windows(t.split("\n"), min_words)
                    if len(found[0]):
                        row.append(np.full(len(found[0]), k))
                        parts.append(found)
                if row:
                    at = pa.array(np.concatenate(row))
                    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[i:j].take(at), batch.column(1)[i:j].take(at), *(pa.array(x) for x in columns[:3]),
                         *(pa.array(x.astype(np.int32)) for x in columns[3:])],
                        names=["doc", "text_key", "mark", "high", "low", "first", "last"])

    return docs.select("doc", "text_key", "text").mapInArrow(
        run, "doc long, text_key long, mark long, high long, low long, first int, last int")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_key, runs): per document the line ranges that repeat an earlier run."""
    found = staged(line_windows(docs, min_words), "lines")
    key = ["mark", "high", "low"]
    firsts = (found.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("doc", "text_key", "first")).alias("origin"))
              .where("copies > 1").drop("copies"))
    later = found.join(firsts, key).where(F.struct("doc", "text_key", "first") != F.col("origin"))
    return later.groupBy("doc", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _with_runs(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """``docs`` with the repeated runs of each row as its last column (null if it has none)."""
    names = [arrays.free_name(docs.columns, x) for x in ("__doc", "__key", "__runs")]
    keys = [F.coalesce(_quoted(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(_quoted(text).cast("string")).alias("text_key")]
    runs = repeated_runs(docs.select(*keys, _quoted(text).cast("string").alias("text")), min_words).toDF(*names)
    rows = docs.select(*[_quoted(c) for c in docs.columns], keys[0].alias(names[0]), keys[1].alias(names[1]))
    return rows.join(runs, names[:2], "left").select(*[_quoted(c) for c in docs.columns], names[2])


def without_runs(text: str, runs: list[dict]) -> tuple[str, int]:
    """The text without the lines that some run covers, and how many those are; blank lines stay."""
    lines = text.split("\n")
    depth = np.zeros(len(lines) + 1, np.int64)
    np.add.at(depth, [r["first"] for r in runs], 1)
    np.add.at(depth, [r["last"] + 1 for r in runs], -1)
    covered = np.cumsum(depth)[:-1] > 0
    kept = [x for x, c in zip(lines, covered.tolist(), strict=True) if not c or not x or x.isspace()]
    return "\n".join(kept), len(lines) - len(kept)


def _rebuilt(rows: DataFrame, at: int, columns: list, schema, counted: bool) -> DataFrame:
    """Apply the runs, the last column, to the text at ``at``; with ``counted`` append the number of deleted lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, at):
            texts, runs = batch.column(at), batch.column(batch.num_columns - 1)
            gone = np.zeros(len(batch), np.int64)
            hit = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                new = texts.to_pylist()
                for k, own in zip(hit.tolist(), runs.take(pa.array(hit)).to_pylist(), strict=True):
                    new[k], gone[k] = without_runs(new[k], own)
                texts = pa.array(new, texts.type)
            out = [texts if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(gone)] * counted, names=columns)

    return rows.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, text without its repeated runs, and n_deleted: one row per row of ``docs``."""
    two = docs.select(_quoted(doc_id).cast("long").alias("doc_id"), _quoted(text).cast("string").alias("text"))
    rows = _with_runs(two, min_words, "doc_id", "text")
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    rows = rows.select("doc_id", lines.alias("n_lines"), "text", rows.columns[-1])
    return _rebuilt(rows, 2, ["doc_id", "n_lines", "text", "n_deleted"], "doc_id long, n_lines long, text string, n_deleted long", True)


def clean(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text without its repeated runs."""
    return _rebuilt(_with_runs(docs, min_words, doc_id, text), docs.columns.index(text), docs.columns, docs.schema, False)
