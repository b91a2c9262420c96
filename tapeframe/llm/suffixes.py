"""Removal of repeated byte strings by a sampled suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else. Sorting all suffixes
would find these side by side; here only the suffixes of a *cover* are sorted, and the others are placed by
them, as in difference-cover suffix sorting.

1. *Cover.* A difference cover samples positions such that any two equal strings share a sampled position at
   the same offset. Here the position is drawn from the content: of the ``gram``-byte grams of a string the
   one of least hash, the leftmost of equals. Equal strings then sample the same offset, and about 1.5 of 100
   positions are sampled (a cover of residues needs 2 of 3 for triples, and 9 of 100 at its sparsest here).
   The strings sampled at one position start in a row, its *domain*.
2. *Names.* A sampled position is named by its gram and by all bytes that its strings can reach. Positions
   whose gram occurs once are done: nothing repeats. Where the whole reach occurs twice, every string of the
   domain repeats. One position stands for each name from here on.
3. *Sampled suffixes.* What is left is sorted among positions of equal gram: by the bytes to the right and by
   those to the left, read backwards. Comparing adjacent prefixes gives each position a name for every depth.
4. *Remaining suffixes.* The string that starts d bytes before a sampled position is named by the pair of the
   left name at depth d and the right name at depth ``length`` - d; it repeats if its pair is not alone. These
   names are exact, bytes against bytes. A gram with too many different reaches for one group is dealt over
   several; strings that are alone in theirs are compared across groups by 128-bit hashes.

Texts are read three times: for grams, for the bytes around the positions left in step 3, and for the removal.
Equal texts are one text with a count, so a text that a third of the rows hold moves once.

Defined results: null texts are empty; texts shorter than ``length`` stay whole; repeated rows are documents
of their own, hence copies of each other; ids play no part and may be null; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm import arrays
from tapeframe.session import staged

_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 200  #: bytes of a string that must not occur twice
    gram: int = 64  #: bytes of the gram that samples a position
    piece: int = 1 << 20  #: string starts that are looked at in one go
    bucket: int = 4096  #: positions that one group sorts, on average; a gram with more reaches is dealt over groups

    @property
    def reach(self) -> int:
        """Bytes before a sampled position at which a string of its domain can start."""
        return self.length - self.gram


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the grams that start at each byte."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = arrays._powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        return arrays.mix((total[size:] - total[:n]) * inverse[:n])


def least_places(key: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least, the leftmost of those that agree in 40 bits."""
    packed = (key & ~_PLACE) | np.arange(len(key), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        packed, span = np.minimum(packed[:-span], packed[span:]), 2 * span
    if span < width:
        rest = width - span
        packed = np.minimum(packed[:len(packed) - rest], packed[rest:])
    return (packed & _PLACE).astype(np.int64)


def sampled(raw: np.ndarray, at: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, ...]:
    """(text, place, first start, last start, gram) of the sampled positions, as places in ``raw``; ``at`` are text offsets."""
    found = []
    window = config.reach + 1
    for begin in range(0, max(0, len(raw) - config.length + 1), config.piece):
        end = min(len(raw), begin + config.piece + config.length - 1)
        key = gram_hashes(raw[begin:end], config.gram)
        place = least_places(key, window)
        start = np.arange(begin, begin + len(place))
        text = np.searchsorted(at, start, "right") - 1
        inside = start + config.length <= at[text + 1]
        start, text, place = start[inside], text[inside], place[inside]
        if not len(start):
            continue
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(cut[1:], len(start)) - 1
        found.append((text[cut], place[cut] + begin, start[cut], start[last], key[place[cut]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    text, place, first, last, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    # A domain that two pieces share is one.
    new = np.concatenate([[True], place[1:] != place[:-1]])
    ends = np.append(np.flatnonzero(new)[1:], len(place)) - 1
    return text[new], place[new], first[new], last[ends], gram[new]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(size, text_key, text): equal texts have equal keys."""
    body = F.coalesce(F.col("`" + text.replace("`", "``") + "`").cast("string"), F.lit(""))
    return docs.select(F.octet_length(body).alias("size"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def grams(rows: DataFrame, config: RepeatConfig) -> DataFrame:
    """(gram, n): how often each gram is sampled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, 2):
            texts = arrays.plain_texts(batch.column(2))
            for i, j in arrays.slices(texts):
                gram, n = np.unique(sampled(*arrays.buffers(texts[i:j]), config)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def positions(rows: DataFrame, config: RepeatConfig) -> DataFrame:
    """(size, text_key, place, back, least, gram, around) of every sampled position: its strings start ``least`` to
    ``back`` bytes before it; ``around`` names all bytes they can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, 2):
            texts = arrays.plain_texts(batch.column(2))
            for i, j in arrays.slices(texts):
                raw, at = arrays.buffers(texts[i:j])
                text, place, first, last, gram = sampled(raw, at, config)
                start = np.maximum(place - config.reach, at[text])
                end = np.minimum(place + config.length, at[text + 1])
                with np.errstate(over="ignore"):
                    around = arrays.mix(arrays.span_hashes(raw, start, end) + (place - start).astype(np.uint64))
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j].take(own), batch.column(1)[i:j].take(own), pa.array(place - at[text], pa.int32()),
                     pa.array(place - first, pa.int16()), pa.array(place - last, pa.int16()), pa.array(gram.view(np.int64)), pa.array(around.view(np.int64))],
                    names=["size", "text_key", "place", "back", "least", "gram", "around"])

    return rows.mapInArrow(run, "size int, text_key long, place int, back short, least short, gram long, around long")


def adjacent(strings: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows of a byte matrix in sorted order, and the length of the prefix that each shares
    with the one before it (the first: -1). Rows end at ``sizes`` and are padded by zeros."""
    order = np.lexsort((sizes, np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel()))
    a, b = strings[order[:-1]], strings[order[1:]]
    differ = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1).argmax(1)
    common = np.minimum(differ, np.minimum(sizes[order[:-1]], sizes[order[1:]]))
    return order, np.concatenate([[-1], common])


def repeated_starts(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, least: np.ndarray, back: np.ndarray,
                    length: int) -> np.ndarray:
    """Per position (row) and d, whether the string that starts d bytes before it starts before another one too.
    ``left`` holds the bytes before the positions, backwards, ``right`` those from them on."""
    out = np.zeros((len(left), left.shape[1] + 1), bool)
    left_order, left_common = adjacent(left, left_size)
    right_order, right_common = adjacent(right, right_size)
    left_name, right_name = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for d in range(int(least.min()), int(back.max()) + 1):
        rows = np.flatnonzero((least <= d) & (d <= back))
        if len(rows) < 2:
            continue
        left_name[left_order] = np.cumsum(left_common < d)
        right_name[right_order] = np.cumsum(right_common < length - d)
        _, name, n = np.unique(left_name[rows] * (len(left) + 1) + right_name[rows], return_inverse=True, return_counts=True)
        out[rows, d] = n[name] > 1
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    wide = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


_SPANS = "size int, text_key long, start int, end int"


def _spans(table: pa.Table | pa.RecordBatch, row: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> list[pa.Array]:
    """Columns of the byte spans of strings that start ``near`` to ``far`` bytes before the positions of the rows."""
    own = table.take(pa.array(row))
    place = own.column("place").to_numpy().astype(np.int64)
    size, key = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (own.column("size"), own.column("text_key")))
    return [size, key, pa.array(place - far, pa.int32()), pa.array(place - near + length, pa.int32())]


_NAMES = ["size", "text_key", "start", "end"]
_COLUMNS = [*_NAMES, "high", "low", "alone"]


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


_STRINGS = f"{_SPANS}, high long, low long, alone boolean"


def _digests(text: list[bytes], split: np.ndarray, row: np.ndarray, d: np.ndarray, length: int) -> np.ndarray:
    """128-bit digests, as two numbers, of the strings that start d bytes before the positions of the rows."""
    parts = zip(row.tolist(), (split[row] - d).tolist(), strict=True)
    return np.frombuffer(b"".join(hashlib.blake2b(text[r][k:k + length], digest_size=16).digest() for r, k in parts), np.int64).reshape(-1, 2)


def _sorted_spans(around: DataFrame, buckets: int, config: RepeatConfig) -> DataFrame:
    """Spans of the repeated strings: a group sorts the positions of some grams, or a part of those of one gram.

    What repeats inside a group is known there. Of a gram in several groups each also returns the strings it
    holds, a row each: those that were alone repeat if another group has them too.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        text, split = table.column("bytes").to_pylist(), table.column("split").to_numpy().astype(np.int64)
        least, back = (table.column(c).to_numpy().astype(np.int64) for c in ("least", "back"))
        left = [t[:s][::-1] for t, s in zip(text, split.tolist(), strict=True)]
        right = [t[s:] for t, s in zip(text, split.tolist(), strict=True)]
        flags = repeated_starts(_matrix(left, config.reach), split, _matrix(right, config.length), np.array([len(x) for x in right]),
                                least, back, config.length)
        found = _spans(table, *_runs(flags), config.length)
        nothing = [pa.nulls(len(found[0]), t) for t in (pa.int64(), pa.int64(), pa.bool_())]
        out = [pa.table([*found, *nothing], names=_COLUMNS)]
        shared = table.column("parts").to_numpy() > 1
        if shared.any():
            place = np.arange(flags.shape[1])
            row, d = np.nonzero(shared[:, None] & (least[:, None] <= place) & (place <= back[:, None]))
            digest, alone = _digests(text, split, row, d, config.length), ~flags[row, d]
            # Of strings that repeat here one row tells the other groups.
            _, first = np.unique(digest, axis=0, return_index=True)
            sent = alone.copy()
            sent[first] = True
            spans = _spans(table, row[sent], d[sent], d[sent], config.length)
            out.append(pa.table([*spans, pa.array(digest[sent, 0]), pa.array(digest[sent, 1]), pa.array(alone[sent])], names=_COLUMNS))
        return pa.concat_tables(out)

    part = F.when(F.col("parts") > 1, F.xxhash64("gram", F.pmod(F.xxhash64("size", "text_key", "place"), F.col("parts")))).otherwise(
        F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    found = staged(around.groupBy((F.col("parts") > 1).alias("is_part"), part.alias("part")).applyInArrow(run, _STRINGS), "strings")
    strings = found.where("high is not null")
    twice = staged(strings.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low"), "twice")
    across = strings.where("alone").join(twice, ["high", "low"], "left_semi")
    return found.where("high is null").select(*_NAMES).unionAll(across.select(*_NAMES))


def _around(rows: DataFrame, asked: DataFrame, config: RepeatConfig) -> DataFrame:
    """The asked positions with the bytes around them; ``split`` bytes stand before the position."""
    texts = rows.where(F.col("size") >= config.length).groupBy("size", "text_key").agg(F.first("text").alias("text"))
    fields = ["place", "back", "least", "gram", "parts"]
    lists = asked.groupBy("size", "text_key").agg(F.collect_list(F.struct(*fields)).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, 2):
            lists = batch.column(3)
            own = pa.array(np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())))
            own_fields = dict(zip(fields, lists.flatten().flatten(), strict=True))
            raw, at = arrays.buffers(arrays.plain_texts(batch.column(2)))
            row, place = own.to_numpy(), own_fields["place"].to_numpy().astype(np.int64)
            begin = np.maximum(at[row] + place - config.reach, at[row])
            end = np.minimum(at[row] + place + config.length, at[row + 1])
            split = at[row] + place - begin
            cut = [raw[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), *own_fields.values(), pa.array(split, pa.int32()), pa.array(cut, pa.binary())],
                names=["size", "text_key", *fields, "split", "bytes"])

    return texts.join(lists, ["size", "text_key"]).mapInArrow(
        run, "size int, text_key long, place int, back short, least short, gram long, parts long, split int, bytes binary")


def repeated_spans(docs: DataFrame, config: RepeatConfig = RepeatConfig(), text: str = "text") -> DataFrame:
    """(size, text_key, start, end): byte spans of each text that repeated strings cover; they may overlap."""
    rows = _keyed(docs, text)
    # Stored, so that the join below reads a table and may split a gram that fills a task.
    twice = staged(grams(rows, config).where("n > 1").select("gram"), "grams")
    found = staged(positions(rows, config).join(twice, "gram"), "positions")
    first = F.min(F.struct("size", "text_key", "place", "back", "least")).alias("first")
    named = staged(found.groupBy("gram", "around").agg(F.count("*").alias("n"), first), "names")
    whole = found.join(named.where("n > 1").select("gram", "around"), ["gram", "around"], "left_semi").select(
        "size", "text_key", (F.col("place") - F.col("back")).alias("start"), (F.col("place") - F.col("least") + config.length).alias("end"))
    several = staged(named.groupBy("gram").agg(F.count("*").alias("reaches")).where("reaches > 1"), "reaches")
    parts = F.ceil(F.col("reaches") / config.bucket).cast("long").alias("parts")
    asked = staged(named.join(several, "gram").select("first.*", "gram", parts), "asked")
    buckets = max(1, asked.where("parts = 1").count() // config.bucket)
    return whole.unionAll(_sorted_spans(_around(rows, asked, config), buckets, config))


def _covered(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that some span covers."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, min(end, size)])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that are left, of every row."""
    spans = repeated_spans(docs, config, text)
    per_text = spans.groupBy("size", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    own = F.col("`" + doc_id.replace("`", "``") + "`").cast("long").alias("doc_id")
    body = F.coalesce(F.col("`" + text.replace("`", "``") + "`").cast("string"), F.lit("")).alias("text")
    rows = docs.select(own, body).select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, 1):
            raw, at = arrays.buffers(arrays.plain_texts(batch.column(1)))
            kept, removed, n_spans = [], [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                data = raw[at[k]:at[k + 1]].tobytes()
                gone = _covered([(s["start"], s["end"]) for s in spans or []], len(data))
                edges = [0, *(x for run in gone for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(len(data) - len(kept[-1]))
                n_spans.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(per_text, ["size", "text_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, config: RepeatConfig = RepeatConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``without_repeats`` with the kept bytes as a digest."""
    return without_repeats(docs, config, doc_id, text).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
