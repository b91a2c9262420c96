"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Texts are lower-cased words (runs of letters and digits); an n-gram is ``n`` consecutive words, a text of
fewer words is one n-gram. Two documents are linked if the Jaccard similarity of their sets of n-grams is
``threshold`` or more.

1. Texts of equal words are one *class*, known by two hashes of the words and numbered as a node; its row of
   least doc_id goes on for all of them. Nodes do not depend on doc_ids, which may be null or repeat.
2. Every representative's MinHash values are cut into bands; bands and rows are chosen so that a pair at
   the threshold meets in some band with probability ``recall``. Band hashes are shuffled, single-member
   buckets go.
3. A bucket all of whose members also share an earlier band is dropped: its pairs are met there. In the
   others a pair counts only in the first band that both share, so no pair is verified twice.
4. N-gram sets of what is left are made from the texts and sent to their buckets. A large bucket is cut
   into blocks and every two blocks meet in a group of their own. A group counts the links of each
   member and returns a row for each, never a row for each pair.
5. Links become classes by connected components; the least doc_id of each is looked up at the end.

Defined results: texts without words (null, empty, only marks) have no links and are classes of their own;
repeated rows are copies of each other; a null doc_id comes before all others; where a doc_id stands for
several texts, each row has the links of its own text; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm import arrays
from tapeframe.llm.components import components
from tapeframe.session import staged

_LOWEST = -(1 << 63)


@dataclass(frozen=True)
class JoinConfig:
    n: int = 5  #: words of an n-gram
    threshold: float = 0.8
    recall: float = 0.999  #: of pairs exactly at the threshold; more above it
    max_hashes: int = 64
    block: int = 256  #: members of a bucket that are compared in one group

    def banding(self) -> tuple[int, int]:
        """(bands, rows): the most selective rows whose bands reach the recall within ``max_hashes``."""
        best = None
        for rows in range(1, self.max_hashes + 1):
            miss = 1 - self.threshold ** rows
            bands = 1 if miss <= 0 else int(np.ceil(np.log(1 - self.recall) / np.log(miss)))
            if bands * rows > self.max_hashes:
                break
            best = bands, rows
        return best or (self.max_hashes, 1)


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of lower-cased texts."""
    raw, at = arrays.buffers(texts)
    row, start, end = arrays.spans(raw, at, arrays.ALNUM)
    return row, arrays.span_hashes(raw, start, end)


def ngrams(row: np.ndarray, key: np.ndarray, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every n-gram, repeats included; texts in ascending order."""
    if not len(row):
        return row, key
    odd = arrays.seeds(n, 21) | np.uint64(1)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(key) - n + 1), np.uint64)
        for i in range(n):
            grams += key[i:len(key) - n + 1 + i] * odd[i]
        grams = arrays.mix(grams)
        inside = row[:len(grams)] == row[n - 1:] if len(grams) else np.zeros(0, bool)
        words = np.bincount(row, minlength=texts)
        few = np.flatnonzero((words > 0) & (words < n))
        if not len(few):
            return row[:len(grams)][inside], grams[inside]
        first = np.searchsorted(row, few)
        whole = np.zeros(len(few), np.uint64)
        for i in range(n - 1):
            has = words[few] > i
            whole[has] += key[first[has] + i] * odd[i]
        whole = arrays.mix(whole + words[few].astype(np.uint64))
    owner = np.concatenate([row[:len(grams)][inside], few])
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate([grams[inside], whole])[order]


def sequence_keys(row: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """Two hashes of each text's word sequence."""
    out = np.zeros((texts, 2), np.uint64)
    if len(row):
        first = np.searchsorted(row, np.arange(texts))
        place = (np.arange(len(row)) - first[row]).astype(np.uint64)
        words = np.bincount(row, minlength=texts)
        some = np.flatnonzero(words)
        with np.errstate(over="ignore"):
            for k, salt in enumerate(arrays.seeds(2, 33)):
                out[some, k] = np.add.reduceat(arrays.mix(key ^ arrays.mix(place * np.uint64(2) + salt)), first[some])
            out[some] = arrays.mix(out[some] + words[some].astype(np.uint64)[:, None])
    return out


def sketches(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """(doc, text_key, high, low, bands) of ``docs`` (doc, text, text_key): the class key and the band hashes; null
    where a text has no words."""
    bands, rows = config.banding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = arrays.seeds(bands * rows, 55)
        for batch in arrays.parts(batches, 1):
            texts = arrays.plain_texts(batch.column(1), lower=True)
            for i, j in arrays.slices(texts):
                row, key = word_keys(texts[i:j])
                sequence = sequence_keys(row, key, j - i).view(np.int64)
                owner, gram = ngrams(row, key, config.n, j - i)
                some, first = np.unique(owner, return_index=True)
                out = np.zeros((len(some), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(bands * rows):
                        value = np.minimum.reduceat((gram ^ seed[k]) * (seed[k] | np.uint64(1)), first) if len(some) else seed[:0]
                        band = out[:, k // rows]
                        band *= np.uint64(0x9FB21C651E98DF25)
                        band += value
                    out = arrays.mix(out + np.arange(bands, dtype=np.uint64)) | np.uint64(1)  # 0 stands for no bucket
                empty = np.ones(j - i, bool)
                empty[some] = False
                offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(sequence[:, 0], mask=empty), pa.array(sequence[:, 1], mask=empty), lists],
                    names=["doc", "text_key", "high", "low", "bands"])

    return docs.mapInArrow(run, "doc long, text_key long, high long, low long, bands array<long>")


def ngram_sets(rows: DataFrame, config: JoinConfig) -> DataFrame:
    """Replace (text, high, low) of ``rows`` by ``grams``, the sorted n-gram set; other texts than the
    class's own are left out. The other columns are passed on."""
    names = [c for c in rows.columns if c not in ("text", "high", "low")]
    schema = rows.select(*names).schema.add("grams", "binary")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, at):
            texts = arrays.plain_texts(batch.column(batch.schema.get_field_index("text")), lower=True)
            key = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("high", "low")])
            for i, j in arrays.slices(texts):
                row, word = word_keys(texts[i:j])
                own = (sequence_keys(row, word, j - i).view(np.int64) == key[i:j]).all(1)
                owner, gram = ngrams(row, word, config.n, j - i)
                first = np.searchsorted(owner, np.arange(j - i + 1))
                sets = [np.unique(gram[first[k]:first[k + 1]]).tobytes() for k in range(j - i)]
                part = batch.slice(i, j - i)
                out = [part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=[*names, "grams"]).filter(pa.array(own))

    return rows.mapInArrow(run, schema)


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of all intersections of the sets of one group, by products of 0/1 matrices."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    times = np.bincount(column) if len(every) else np.zeros(0, np.int64)
    shared = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((len(sets), min(width, int(column[hi - 1]) - k * width + 1) if hi > lo else 1), np.float32)
        part[owner[lo:hi], column[lo:hi] - k * width] = 1
        out += part @ part.T
    return out


def verify_group(band: int, part: np.ndarray, nodes: np.ndarray, copies: np.ndarray, bands: np.ndarray, sets: list[np.ndarray],
                 threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, links) of the members that have links in this group."""
    size = np.array([len(s) for s in sets])
    wanted = np.triu(np.ones((len(nodes), len(nodes)), bool), 1)
    if part[0] != part[-1] or len(set(part.tolist())) > 1:
        wanted &= part[:, None] != part[None, :]
    for k in range(band):
        wanted &= ~((bands[:, k][:, None] == bands[:, k][None, :]) & (bands[:, k] != 0)[:, None])
    wanted &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
    if not wanted.any():
        return nodes[:0], nodes[:0], copies[:0]
    common = intersections(sets)
    union = size[:, None] + size[None, :] - common
    linked = wanted & (common >= threshold * union - 1e-9)
    linked |= linked.T
    links = linked @ copies
    root = np.arange(len(nodes))
    while True:  # the least member reachable by links
        near = np.where(linked, root[None, :], len(nodes)).min(1)
        lower = np.minimum(root, near)
        if (lower == root).all():
            break
        root = lower[lower]
    has = links > 0
    return nodes[has], nodes[root[has]], links[has]


def links(docs: DataFrame, config: JoinConfig = JoinConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, found) for ``docs`` (doc, text): members (doc, text_key, node, copies) with the node of each
    document, below 0 where it has no words; nodes (node, doc, text_key) with the row that stands for each; found
    (node, root, links), rows of the verified groups."""
    bands, _ = config.banding()
    docs = docs.select("doc", "text", F.xxhash64("text").alias("text_key"))
    sketch = staged(sketches(docs, config), "sketches")
    least = F.min(F.struct("doc", "text_key")).alias("least")
    classes = sketch.where("high is not null").groupBy("high", "low").agg(least, F.count("*").alias("copies"))
    # Stored, so that the numbers stay the same for all readers.
    classes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "high", "low", "least", "copies"), "nodes")
    own = ["doc", "text_key", "node", "copies", "high", "low", "bands"]
    worded = sketch.join(classes, ["high", "low"]).select(*own, (F.struct("doc", "text_key") == F.col("least")).alias("first"))
    # Numbers below 0, so that texts without words are spread over later joins and meet nothing.
    wordless = sketch.where("high is null").withColumns({"node": -1 - F.monotonically_increasing_id(), "copies": F.lit(1).cast("long")})
    members = staged(worded.unionAll(wordless.select(*own, F.lit(False))), "members")
    single = members.where("first").dropDuplicates(["node"])
    spread = single.select("node", F.posexplode("bands").alias("band", "bucket"))
    crowded = spread.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    seats = staged(spread.join(crowded, ["band", "bucket"]), "seats")
    # Per node the bucket of each band, 0 where it is alone there.
    by_band = seats.groupBy("node").pivot("band", list(range(bands))).agg(F.first("bucket"))
    shape = by_band.select("node", F.array(*[F.coalesce(F.col(str(k)), F.lit(0)).cast("long") for k in range(bands)]).alias("shape"))
    seated = seats.join(shape, "node")
    at = lambda k: F.element_at("shape", k + 1)
    same = [F.when((F.min(at(k)) == F.max(at(k))) & (F.min(at(k)) != 0) & (F.col("band") > k), True).otherwise(False) for k in range(bands - 1)]
    useful = seated.groupBy("band", "bucket").agg(F.lit(False).alias("none"), *[x.alias(f"s{k}") for k, x in enumerate(same)])
    useful = useful.where(~F.greatest(*[F.col(f"s{k}").cast("int") for k in range(bands - 1)], F.lit(0), F.lit(0)).cast("boolean")).select("band", "bucket")
    seats_of = (seated.join(useful, ["band", "bucket"]).groupBy("node", "shape")
                .agg(F.collect_list(F.struct("band", "bucket", F.ceil(F.col("size") / config.block).cast("int").alias("blocks"))).alias("seats")))
    asked = seats_of.join(single.select("node", "doc", "text_key", "copies", "high", "low"), "node")
    texts = docs.join(asked, ["doc", "text_key"]).select("node", "shape", "seats", "copies", "high", "low", "text")
    sets = ngram_sets(texts, config)
    seat = sets.select("node", "shape", "copies", "grams", F.explode("seats").alias("s")).select(
        "node", "shape", "copies", "grams", "s.*", F.pmod(F.xxhash64("node"), F.col("s.blocks")).cast("int").alias("part"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    paired = seat.select("*", other).select(
        "node", "shape", "copies", "grams", "band", "bucket", "part",
        F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        found = verify_group(
            table.column("band")[0].as_py(), table.column("part").to_numpy(), nodes, table.column("copies").to_numpy(),
            np.array(table.column("shape").to_pylist(), np.int64), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")],
            config.threshold) if len(nodes) > 1 else (nodes[:0],) * 3
        return pa.table({"node": pa.array(found[0], pa.int64()), "root": pa.array(found[1], pa.int64()), "links": pa.array(found[2], pa.int64())})

    found = paired.groupBy("band", "bucket", "p", "q").applyInArrow(run, "node long, root long, links long")
    return members.select("doc", "text_key", "node", "copies"), classes.select("node", "least.*"), found


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("doc"), F.col(text).cast("string").alias("text"))


def _least(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, least) for every node that has links: the first (doc, text_key) that links lead to."""
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = nodes.join(roots, "node").groupBy("root").agg(F.min(F.struct("doc", "text_key")).alias("least"))
    return roots.join(least, "root").select("node", "least")


def classes(docs: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id that links lead to) and n_links, the number of other documents
    at the threshold or above, one row per row of ``docs``."""
    members, nodes, found = links(_own(docs, doc_id, text), config)
    found = staged(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    alone = nodes.select("node", F.struct("doc", "text_key").alias("own"))
    known = alone.join(counts, "node", "left").join(_least(nodes, found), "node", "left")
    known = known.select("node", "links", F.coalesce("least", "own")["doc"].alias("first"))
    back = lambda c: F.when(c != _LOWEST, c)
    return members.join(known, "node", "left").select(
        back(F.col("doc")).alias("doc_id"), back(F.coalesce("first", "doc")).alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def clean(docs: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one of least doc_id, with all its columns; of rows that repeat a
    doc_id and its text one stays."""
    members, nodes, found = links(_own(docs, doc_id, text), config)
    own = F.struct("doc", "text_key")
    known = nodes.select("node", own.alias("own")).join(_least(nodes, staged(found, "found")), "node", "left")
    known = known.select("node", F.coalesce("least", "own").alias("least"))
    keys = [arrays.free_name(docs.columns, x) for x in ("__doc", "__key")]
    gone = members.join(known, "node").where(own != F.col("least")).select(F.col("doc").alias(keys[0]), F.col("text_key").alias(keys[1])).distinct()
    name, body = ("`" + c.replace("`", "``") + "`" for c in (doc_id, text))
    values = (F.coalesce(F.col(name).cast("long"), F.lit(_LOWEST)), F.xxhash64(F.col(body).cast("string")))
    kept = docs.withColumns(dict(zip(keys, values, strict=True))).join(gone, keys, "left_anti")
    return kept.dropDuplicates(keys).select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])
