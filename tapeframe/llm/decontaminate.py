"""Benchmark decontamination: random-walk embeddings, bit-sampling LSH, exact edit verification.

Texts and items are lower-cased words (runs of letters and digits) joined by one space, as bytes. A random
walk (CGK) from a window's start emits one byte per step and, by a random bit of step and byte, moves on or
stays. Two windows at a small edit distance fall back into step, so their emitted sequences differ in few
places: edit distance becomes Hamming distance. A repetition has its own random bits and samples some of the
steps; the sampled bytes are the bucket key. Windows start at anchors, places whose two bytes fall into a
fixed class, so item and document agree on them wherever these bytes are unedited.

An item of n characters is embedded by windows over its whole length. It is a candidate where windows from
two places of it meet the document in one item-sized stretch, at starts that differ by no more edits than
allowed. The length of the walks and the number of repetitions are not fixed: for every size class of items
the most selective ones are taken whose recall, tried on edited copies of the class's own items at
``max_distance``, is ``recall`` or more. (One walk over a whole item does not reach it: at one edit in five
characters two such walks are out of step for good, and what they emit agrees as little as chance.)

A candidate counts if the item is within ``max_distance`` of its own length, in characters, of some
substring of the stretch: exact edit distance, by bit-parallel dynamic programming. Keys of chance cost
time, never a wrong row. An unedited copy is never missed.

Defined results: null and empty texts and items without a word match nothing; an item of few words is
matched by shorter windows, a single one being enough; rows that repeat are reported alike; equal item_ids
with other texts are further items of that id; a null doc_id is kept; an empty benchmark leaves every
document clean; extra columns are ignored by ``matches`` and passed through by ``clean``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm import arrays

_SPACE = 32
#: Slots of the first look-up, by the bytes that all walks of a repetition sample first.
_SEEN_BITS = 20
_HEAD_STEPS, _HEAD = 12, 4
#: (steps, repetitions) of a size class, the most selective first.
_DESIGNS = ((64, 2), (64, 3), (64, 4), (48, 3), (48, 4), (40, 3), (40, 4), (32, 3), (32, 4), (28, 3), (28, 4), (24, 3), (20, 3), (16, 3), (16, 4))


@dataclass(frozen=True)
class LeakConfig:
    max_distance: float = 0.2  #: edits per character of the item
    recall: float = 0.9  #: of items with as many random edits as ``max_distance`` allows
    anchor: int = 4  #: one in so many places starts a window
    samples: int = 8  #: sampled steps of a walk
    trials: int = 96  #: edited copies that a design is tried on; they set the walks, never what counts
    block_bytes: int = 4 << 20  #: benchmark text that one pass over the documents holds in memory


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the words of each lower-cased text, a space after each."""
    raw, at = arrays.buffers(texts)
    row, start, end = arrays.spans(raw, at, arrays.ALNUM)
    place = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.full(place[-1], _SPACE, np.uint8)
    inside = np.flatnonzero(arrays.ALNUM[raw])
    out[inside + np.repeat(place[:-1] - start, end - start)] = raw[inside]
    return out, place[np.searchsorted(row, np.arange(len(at)))]


def anchors(text: np.ndarray, one_in: int) -> np.ndarray:
    """The places where two bytes of a fixed class start; all, if ``one_in`` is 1."""
    if one_in == 1:
        return np.arange(len(text))
    chosen = arrays.seeds(1 << 16, 3) % np.uint64(one_in) == 0
    return np.flatnonzero(chosen[text[:-1].astype(np.int64) << 8 | text[1:]]) if len(text) else np.zeros(0, np.int64)


def _steps(steps: int, repetition: int, config: LeakConfig) -> list[int]:
    """The sampled steps: the first few are the same for walks of every length."""
    head = np.random.default_rng([repetition, 0])
    tail = np.random.default_rng([repetition, steps])
    rest = np.array_split(np.arange(_HEAD_STEPS, steps), config.samples - _HEAD)
    return [int(head.choice(x)) for x in np.array_split(np.arange(_HEAD_STEPS), _HEAD)] + [int(tail.choice(x)) for x in rest if len(x)]


def walk(text: np.ndarray, start: np.ndarray, lengths: list[int], repetition: int, config: LeakConfig,
         seen: np.ndarray | None = None) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(kept, keys, ends) of the windows at ``start``: for each length of walk the sampled bytes as one number and
    the last place sampled. With ``seen`` only windows are kept whose first samples it knows."""
    bits = (arrays.seeds(256 * max(lengths), 1000 + repetition) >> np.uint64(17) & np.uint64(1)).astype(np.int64).reshape(-1, 256)
    # The walk may step past the text; it then stays on spaces.
    text = np.concatenate([text, np.full(max(lengths) + 1, _SPACE, np.uint8)])
    sampled = {n: _steps(n, repetition, config) for n in lengths}
    kept, at = np.arange(len(start)), start.copy()
    keys = {n: np.zeros(len(start), np.uint64) for n in lengths}
    ends = {}
    for step in range(1 + max(s[-1] for s in sampled.values())):
        here = text[at]
        if step == _HEAD_STEPS and seen is not None:
            alive = np.flatnonzero(seen[_slot(keys[lengths[0]])])
            kept, at, here = kept[alive], at[alive], here[alive]
            keys = {n: k[alive] for n, k in keys.items()}
        for n in lengths:
            if step in sampled[n]:
                keys[n] <<= np.uint64(8)
                keys[n] |= here
                if step == sampled[n][-1]:
                    ends[n] = at.copy()
        at += bits[step][here]
    return kept, keys, ends


def _slot(head: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (head * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)


def distance_within(pattern: str, text: str, limit: int) -> int | None:
    """The least edit distance of ``pattern`` to a substring of ``text``, None if above ``limit``.

    The columns of the dynamic program are kept as two bit vectors of vertical differences (+1, -1).
    """
    m = len(pattern)
    if m == 0:
        return 0
    if pattern in text:
        return 0
    if limit == 0:
        return None
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    up, down, value, best = full, 0, m, m
    for c in text:
        match = masks.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & high:
            value += 1
        elif right_down & high:
            value -= 1
            if value < best:
                best = value
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
    return best if best <= limit else None


def shares_grams(pattern: str, text: str, limit: int, size: int = 4) -> bool:
    """Whether ``text`` has enough of the pattern's grams to hold it within ``limit`` edits: an edit spoils at most
    ``size`` of them."""
    needed = len(pattern) - size + 1 - limit * size
    if needed <= 0:
        return True
    own = {text[i:i + size] for i in range(len(text) - size + 1)}
    return sum(pattern[i:i + size] in own for i in range(len(pattern) - size + 1)) >= needed


class Windows:
    """The buckets of items of one size class."""

    def __init__(self, text: np.ndarray, at: np.ndarray, one_in: int, steps: int, repetitions: int, config: LeakConfig):
        self.one_in, self.steps, self.config = one_in, steps, config
        self.size = np.diff(at)
        self.gap = 1 + (self.size * config.max_distance / 2).astype(np.int64)
        start = anchors(text, one_in)
        item = np.searchsorted(at, start, "right") - 1
        start, item = start[start < at[-1]], item[start < at[-1]]
        self.tables = []
        first, last = np.full(len(self.size), 1 << 60), np.zeros(len(self.size), np.int64)
        for r in range(repetitions):
            _, keys, ends = walk(text, start, [steps], r, config)
            # A window that leaves its item is no window of it.
            own = np.flatnonzero(ends[steps] < at[item + 1] - 1)
            offset = (start - at[item])[own]
            np.minimum.at(first, item[own], offset)
            np.maximum.at(last, item[own], offset)
            key = keys[steps][own]
            order = np.argsort(key, kind="stable")
            known = np.zeros(1 << _SEEN_BITS, bool)
            known[_slot(key)] = True
            self.tables.append((key[order], item[own][order], offset[order], known))
        #: One window is enough for an item whose windows start at one place.
        self.single = last - first < 4

    def heads(self, repetition: int) -> np.ndarray:
        key = self.tables[repetition][0]
        return _slot(key >> np.uint64(8 * (len(_steps(self.steps, repetition, self.config)) - _HEAD)))

    def hits(self, repetition: int, start: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, offset in the item) of every meeting."""
        key, item, offset, known = self.tables[repetition]
        maybe = np.flatnonzero(known[_slot(got)])
        start, got = start[maybe], got[maybe]
        low, high = np.searchsorted(key, got, "left"), np.searchsorted(key, got, "right")
        met = np.flatnonzero(high > low)
        n = high[met] - low[met]
        slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[met], n)
        return np.repeat(start[met], n), item[slot], offset[slot]

    def stretches(self, found: list, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first start, last start) where windows of two places of an item, or of one if that is
        all it has, agree on where it starts."""
        place, item, offset = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if not len(place):
            return []
        doc = np.searchsorted(at, place, "right") - 1
        begin = place - offset
        order = np.lexsort((begin, item, doc))
        doc, item, begin, offset = doc[order], item[order], begin[order], offset[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > self.gap[item[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        spread = np.maximum.reduceat(offset, first) - np.minimum.reduceat(offset, first)
        take = (spread >= 4) | self.single[item[first]]
        first, last = first[take], last[take]
        return list(zip(doc[first].tolist(), item[first].tolist(), begin[first].tolist(), begin[last].tolist(), strict=True))


def _edited(text: str, edits: int, rng: random.Random) -> str:
    """``text`` with so many characters replaced, added or dropped, half of them replaced."""
    out = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(out) + 1), rng.randrange(4)
        if kind < 2 and out:
            out[min(i, len(out) - 1)] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        elif kind == 2:
            out.insert(i, rng.choice("abcdefghijklmnopqrstuvwxyz"))
        elif out:
            del out[min(i, len(out) - 1)]
    return "".join(out)


def _designed(items: list[str], config: LeakConfig) -> Windows:
    """The most selective windows of a size class that find the target share of edited copies of its items."""
    text, at = normal(arrays.plain_texts(pa.array(items, pa.large_string())))
    rng = random.Random(5)
    tried = [k % len(items) for k in range(max(config.trials, 1))]
    copies = [_edited(items[k], int(config.max_distance * len(items[k])), rng) for k in tried]
    edited, places = normal(arrays.plain_texts(pa.array([f"{' zq' * 20} {c} {'qz ' * 20}" for c in copies], pa.large_string()), lower=True))
    for one_in in (config.anchor, 1):
        for steps, repetitions in _DESIGNS:
            made = Windows(text, at, one_in, steps, repetitions, config)
            if len(np.unique(np.concatenate([t[1] for t in made.tables]))) < len(items):
                continue  # an item without windows would miss even unedited copies
            start, found = anchors(edited, one_in), []
            for r in range(repetitions):
                _, keys, _ = walk(edited, start, [steps], r, config)
                found.append(made.hits(r, start, keys[steps]))
            got = {(d, i) for d, i, _, _ in made.stretches(found, places)}
            if sum((d, k) in got for d, k in enumerate(tried)) >= config.recall * len(tried):
                return made
    # Items of a word or two: the shortest walks from every place.
    return Windows(text, at, 1, _HEAD_STEPS + 1, 1, config)


class Benchmark:
    """One block of items: windows per size class, and the texts to verify against."""

    def __init__(self, items: list[tuple[int, str]], config: LeakConfig):
        self.config = config
        texts = arrays.plain_texts(pa.array([t for _, t in items], pa.large_string()), lower=True)
        raw, at = normal(texts)
        by_size: dict[int, list[tuple[int, str]]] = {}
        for k, (item_id, _) in enumerate(items):
            own = raw[at[k]:at[k + 1] - 1].tobytes().decode() if at[k + 1] > at[k] else ""
            if own:
                by_size.setdefault(len(own).bit_length(), []).append((item_id, own))
        #: (windows, items, first looks per repetition) of each class; very short items are looked for whole.
        self.classes, self.short = [], []
        for _, own in sorted(by_size.items()):
            made = _designed([t for _, t in own], config)
            known = np.unique(np.concatenate([t[1] for t in made.tables]))
            self.classes.append((made, own))
            self.short += [own[k] for k in sorted(set(range(len(own))) - set(known.tolist()))]
        self.seen = {}
        for one_in in {m.one_in for m, _ in self.classes}:
            for r in range(max(len(m.tables) for m, _ in self.classes if m.one_in == one_in)):
                seen = np.zeros(1 << _SEEN_BITS, bool)
                for m, _ in self.classes:
                    if m.one_in == one_in and r < len(m.tables):
                        seen[m.heads(r)] = True
                self.seen[one_in, r] = seen

    def find(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item_id, distance) for every text and item of it; ``texts`` are lower-cased."""
        text, at = normal(texts)
        if not len(text):
            return []
        found: list[list] = [[] for _ in self.classes]
        for one_in in {m.one_in for m, _ in self.classes}:
            every = anchors(text, one_in)
            for r in range(max(len(m.tables) for m, _ in self.classes if m.one_in == one_in)):
                own = [k for k, (m, _) in enumerate(self.classes) if m.one_in == one_in and r < len(m.tables)]
                lengths = sorted({self.classes[k][0].steps for k in own})
                kept, keys, _ = walk(text, every, lengths, r, self.config, self.seen[one_in, r])
                for k in own:
                    made = self.classes[k][0]
                    found[k].append(made.hits(r, every[kept], keys[made.steps]))
        best: dict[tuple[int, int], int] = {}
        for (made, items), hits in zip(self.classes, found, strict=True):
            for doc, item, first, last in made.stretches(hits, at):
                self._verify(best, text, at, doc, items[item], first, last)
        for item in self.short:
            for doc in range(len(texts)):
                self._verify(best, text, at, doc, item, int(at[doc]), int(at[doc + 1]))
        return [(doc, item, d) for (doc, item), d in best.items()]

    def _verify(self, best: dict, text: np.ndarray, at: np.ndarray, doc: int, item: tuple[int, str], first: int, last: int) -> None:
        item_id, pattern = item
        if best.get((doc, item_id)) == 0:
            return
        size = len(pattern.encode())
        # Of a true match every window starts where the item does, give or take the characters added or dropped.
        edits = 4 + int(size * self.config.max_distance)
        low, high = max(int(at[doc]), first - edits), min(int(at[doc + 1]), last + size + 2 * edits)
        stretch = text[low:high].tobytes().decode(errors="ignore")
        if not shares_grams(pattern, stretch, int(self.config.max_distance * len(pattern))):
            return
        found = distance_within(pattern, stretch, int(self.config.max_distance * len(pattern)))
        if found is not None:
            best[doc, item_id] = min(found, best.get((doc, item_id), found))


def _blocks(benchmark: DataFrame, config: LeakConfig, item_id: str, text: str) -> Iterator[Benchmark]:
    """The benchmark in parts of about ``block_bytes``, each small enough to go with a task."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // config.block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Benchmark([(r.item_id, r.text) for r in sorted(part, key=lambda r: (r.item_id is None, r.item_id or 0, r.text))], config)


def matches(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id and distance: the benchmark items that each document holds."""
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, config, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in arrays.parts(batches, 1):
                texts, ids = arrays.plain_texts(batch.column(1), lower=True), batch.column(0)
                for i, j in arrays.slices(texts):
                    found = shared.value.find(texts[i:j])
                    if found:
                        row, item, distance = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [ids[i:j].take(pa.array(row)), pa.array(item, pa.int64()), pa.array(distance, pa.int32())],
                            names=["doc_id", "item_id", "distance"])

        part = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
            run, "doc_id long, item_id long, distance int")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    at = docs.columns.index(text)
    for block in _blocks(benchmark, config, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in arrays.parts(batches, at):
                texts = arrays.plain_texts(batch.column(at), lower=True)
                keep = np.ones(len(texts), bool)
                for i, j in arrays.slices(texts):
                    for row, _, _ in shared.value.find(texts[i:j]):
                        keep[i + row] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
