"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn by rule from its code point. An n-gram's vector
binds (multiplies) the vectors of its letters, each permuted (rolled) by its place; a text's vector
bundles (adds) those of its n-grams, a language's prototype those of its training texts. The predicted
language is that of the prototype nearest by cosine.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for every text if
nothing was learned; equal cosines go to the first language by name; a repeated row gets a row each; a
null doc_id is predicted and counts as training; rows without lang are predicted only; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm import arrays
from tapeframe.llm.quality import held_out


@dataclass(frozen=True)
class ProfileConfig:
    dimensions: int = 512
    seed: int = 11


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(codes: np.ndarray, config: ProfileConfig) -> np.ndarray:
    """One row of +1/-1 per code point; code 0, the word edge, has a vector too."""
    with np.errstate(over="ignore"):
        words = -(-config.dimensions // 64)
        keys = codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
        bits = arrays.mix(arrays.mix(keys + np.uint64(config.seed << 40)) + np.uint64(config.seed))
    flat = np.unpackbits(bits.view(np.uint8).reshape(len(codes), -1), axis=1)[:, :config.dimensions]
    return flat.astype(np.int8) * np.int8(2) - np.int8(1)


def bundles(texts: pa.Array, config: ProfileConfig, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(bundle, letters): the sum of each text's n-gram vectors, and how many letters it has.

    Distinct n-grams are taken ``block`` at a time, so memory does not grow with their number, which large
    alphabets drive up. Sums are of whole numbers, hence exact in any order.
    """
    own = texts.to_pylist()
    points = np.frombuffer("\n".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    length = np.array([len(t) for t in own], np.int64)
    text_of = np.repeat(np.arange(len(length)), length + 1)[:len(points)]
    found = np.bincount(text_of[letter], minlength=len(length))
    out = np.zeros((len(length), config.dimensions))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one edge after each word
    codes, owner = np.where(letter, points, 0)[keep], text_of[keep]
    if not len(codes):
        return out, found
    codes = np.concatenate([[0], codes, [0]]).astype(np.int64)
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    x, a = place[codes], len(alphabet)
    inner = codes[1:-1] != 0
    gram, owner = ((x[:-2] * a + x[1:-1]) * a + x[2:])[inner], owner[inner]
    if a ** 3 <= 1 << 23:
        every = np.flatnonzero(np.bincount(gram, minlength=1))
        slot = np.zeros(every[-1] + 1, np.int64)
        slot[every] = np.arange(len(every))
        number = slot[gram]
    else:
        every, number = np.unique(gram, return_inverse=True)
    if len(every) > block:
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
    base = letter_vectors(alphabet, config)
    for low in range(0, len(every), block):
        present = every[low:low + block]
        begin, end = (0, len(number)) if len(every) <= block else np.searchsorted(number, [low, low + block])
        counts = np.bincount(owner[begin:end] * len(present) + number[begin:end] - low, minlength=len(length) * len(present))
        vectors = np.roll(base[present // (a * a)], 2, 1) * np.roll(base[present // a % a], 1, 1) * base[present % a]
        out += counts.reshape(len(length), -1).astype(np.float32) @ vectors.astype(np.float32)
    return out, found


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of bounded text and of bounded count matrices."""
    for i, j in arrays.slices(texts, 1 << 20):
        for k in range(i, j, 512):
            yield k, min(j, k + 512)


def prototypes(docs: DataFrame, config: ProfileConfig = ProfileConfig(), text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language to the bundle of all its texts. One vector per language reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[str, np.ndarray] = {}
        for batch in arrays.parts(batches, 0):
            texts = arrays.plain_texts(batch.column(0), lower=True)
            names = batch.column(1).to_pylist()
            for i, j in _groups(texts):
                bundle, _ = bundles(texts[i:j], config)
                for name in set(names[i:j]):
                    rows = np.array([x == name for x in names[i:j]])
                    total[name] = total.get(name, 0) + bundle[rows].sum(0)
        shard = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([shard] * len(total), pa.int32()),
             pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "shard", "v"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    summed = arrays.merge_sums(rows.mapInArrow(run, "lang string, shard int, v binary"), ["lang"]).collect()
    return {r.lang: np.frombuffer(bytes(r.v), np.float64) for r in sorted(summed, key=lambda r: r.lang)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], config: ProfileConfig = ProfileConfig(), doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, from 0 to 1) for every row."""
    known = {k: v for k, v in profiles.items() if np.linalg.norm(v) > 0}
    names = list(known)
    unit = np.stack([v / np.linalg.norm(v) for v in known.values()]).astype(np.float32) if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.parts(batches, 2):
            texts = arrays.plain_texts(batch.column(2), lower=True)
            for i, j in _groups(texts):
                bundle, found = bundles(texts[i:j], config)
                best, value = np.full(j - i, -1), np.zeros(j - i)
                if names and found.any():
                    size = np.linalg.norm(bundle, axis=1)
                    cosine = bundle @ unit.T / np.maximum(size, 1e-9)[:, None]
                    best = np.where(found > 0, cosine.argmax(1), -1)
                    value = np.where(found > 0, np.clip(cosine.max(1), 0, 1), 0)
                lang = pa.array([names[b] if b >= 0 else "und" for b in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], lang, pa.array(value, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """Learn from the rows outside the held-out fold, then predict every row."""
    return predict(docs, prototypes(docs.where(~held_out("doc_id")), config), config)
