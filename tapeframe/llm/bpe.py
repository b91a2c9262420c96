"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Adjacent pairs whose concatenation has a merge rank wait in
buckets, one per rank, that hold list positions; a two-level bitmap over the ranks gives the next
non-empty bucket by find-first-set. An entry whose pair has changed since it was queued is skipped.
Every merge costs a bounded number of queue steps, so a pre-token of n bytes takes O(n log n) and a
megabyte without a break is no special case.

Defined results: a null text counts as empty; an empty text has no ids and decodes to nothing; a
repeated row or doc_id gives one row each; a null doc_id is kept; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm import arrays

_BITS = 9
_MASK = (1 << _BITS) - 1
_ID_BITS = 32

#: Bytes of text that are split and encoded together.
_STEP_BYTES = 2 << 20

#: Pre-tokens a worker remembers; beyond that it forgets all and starts anew. Results do not change.
CACHE_ENTRIES = 300_000


def encode_piece(piece: bytes, byte_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token: repeatedly merge the leftmost pair of the lowest rank.

    ``buckets[rank]`` is a heap of list positions; bit ``rank & 511`` of ``words[rank >> 9]`` and bit
    ``rank >> 9`` of ``top`` say which buckets hold entries. The queue is written out in the loop,
    since most pre-tokens are short and a call per step would take most of the time.
    """
    ids = [byte_ids[b] for b in piece]
    n = len(ids)
    after = list(range(1, n + 1))  # the next live position
    before = list(range(-1, n - 1))
    wanted = [-1] * n  # rank of the pair that begins here, -1 if there is none
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    find = pairs.get
    for i in range(n - 1):
        rank = find(ids[i] << _ID_BITS | ids[i + 1], -1)
        if rank >= 0:
            wanted[i] = rank
            if rank in buckets:
                buckets[rank].append(i)  # ascending, so still a heap
            else:
                buckets[rank] = [i]
                block = rank >> _BITS
                words[block] = words.get(block, 0) | 1 << (rank & _MASK)
                top |= 1 << block
    while top:
        block = (top & -top).bit_length() - 1
        word = words[block]
        rank = block << _BITS | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            word &= word - 1
            words[block] = word
            if not word:
                top &= top - 1
        if wanted[i] != rank:
            continue  # stale: this pair has changed since
        j = after[i]
        end = after[i] = after[j]
        ids[i] = rank
        wanted[j] = wanted[i] = -1
        ids[j] = -1
        starts = []
        if end < n:
            before[end] = i
            starts.append((i, rank << _ID_BITS | ids[end]))
        k = before[i]
        if k >= 0:
            starts.append((k, ids[k] << _ID_BITS | rank))
        for k, pair in starts:
            new = wanted[k] = find(pair, -1)
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], k)
                else:
                    buckets[new] = [k]
                    block = new >> _BITS
                    words[block] = words.get(block, 0) | 1 << (new & _MASK)
                    top |= 1 << block
    return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(maxsize=4)
def pair_ranks(path: str) -> dict[int, int]:
    """(left id, right id) to the rank of their concatenation, for every split of every token."""
    ranks = load_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << _ID_BITS | right] = rank
    return pairs


class MergeTable:
    """The merge ranks of a vocabulary as sorted arrays, for look-ups of many pairs at once."""

    def __init__(self, path: str):
        self.ranks, self.pairs = load_ranks(path), pair_ranks(path)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.bytes = np.array(self.byte_ids, np.int64)
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << _ID_BITS | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.values[at], -1)


def encode_pieces(pieces: list[bytes], table: MergeTable) -> list[bytes]:
    """Packed ids of many pre-tokens at once, all in one linked list that no pair bridges.

    The queue is the one of ``encode_piece``, but the lowest bucket is emptied in one step: its
    positions are independent, save runs that overlap (``aaa``), of which every second one merges. A
    step that makes a pair of lower rank than its own would have to be taken apart; a vocabulary whose
    tokens are reached by their own merges has none, and for others the pieces go one by one.
    """
    if not pieces or not len(table.keys):
        return [_packed(encode_piece(p, table.byte_ids, table.pairs)) for p in pieces]
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw)
    lengths = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    ids = np.full(n + 1, 1 << 31, np.int64)  # slot n is the end of every piece
    ids[:n] = table.bytes[raw]
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1], before[starts] = n, n
    wanted = np.full(n + 1, -1, np.int64)
    wanted[:n] = table.find(ids[:n], ids[after[:n]])
    buckets: dict[int, list[np.ndarray]] = {}
    words: dict[int, int] = {}
    top = 0

    def push(ranks: np.ndarray, positions: np.ndarray) -> int:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        added = 0
        for k, rank in enumerate(ranks[bounds[:-1]].tolist()):
            part = positions[bounds[k]:bounds[k + 1]]
            if rank in buckets:
                buckets[rank].append(part)
            else:
                buckets[rank] = [part]
                block = rank >> _BITS
                words[block] = words.get(block, 0) | 1 << (rank & _MASK)
                added |= 1 << block
        return added

    live = np.flatnonzero(wanted >= 0)
    if len(live):
        top |= push(wanted[live], live)
    while top:
        block = (top & -top).bit_length() - 1
        word = words[block]
        rank = block << _BITS | (word & -word).bit_length() - 1
        parts = buckets.pop(rank)
        words[block] = word & word - 1
        if not words[block]:
            top &= top - 1
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[wanted[at] == rank]  # the rest is stale
        if not len(at):
            continue
        if len(at) > 1:
            at = np.unique(at)
        j = after[at]
        chained = np.zeros(len(at), bool)
        chained[1:] = at[1:] == j[:-1]
        if chained.any():
            order = np.arange(len(at))
            keep = (order - np.maximum.accumulate(np.where(chained, 0, order))) % 2 == 0
            at, j = at[keep], j[keep]
        end = after[j]
        ids[at], ids[j] = rank, -1
        wanted[at], wanted[j] = -1, -1
        after[at] = end
        before[end] = at
        left = before[at]
        touched = np.concatenate([at, left[left < n]])
        new = table.find(ids[touched], ids[after[touched]])
        wanted[touched] = new
        queued = new >= 0
        if queued.any():
            new, touched = new[queued], touched[queued]
            if new.min() < rank:
                return [_packed(encode_piece(p, table.byte_ids, table.pairs)) for p in pieces]
            top |= push(new, touched)
    alive = ids[:n] >= 0
    blob = ids[:n][alive].astype("<u4").tobytes()
    cuts = (4 * np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]).tolist()
    return [blob[cuts[k]:cuts[k + 1]] for k in range(len(pieces))]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder of one vocabulary and one splitting pattern."""

    def __init__(self, path: str, pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.table = MergeTable(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.limit = cache_entries
        self.tokens: list[bytes] = [b""] * (max(self.table.ranks.values(), default=-1) + 1)
        for token, rank in self.table.ranks.items():
            self.tokens[rank] = token

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed little-endian uint32 ids of each text."""
        split = [self.split(t) for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        new = {p for pieces in split for p in pieces}
        new.difference_update(known)
        if new:
            names, raw = [], []
            for p in new:
                b = p.encode()
                whole = self.table.ranks.get(b)
                if whole is None:
                    names.append(p)
                    raw.append(b)
                else:
                    known[p] = _packed([whole])
            known.update(zip(names, encode_pieces(raw, self.table), strict=True))
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the packed little-endian uint32 ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in arrays.parts(batches, 1):
            texts = arrays.plain_texts(batch.column(1))
            for i, j in arrays.slices(texts, _STEP_BYTES):
                ids = one.encode_all(texts[i:j].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return _two(docs, doc_id, text).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ``ids`` and ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in batches:
            step = 256
            for i in range(0, len(batch), step):
                part = batch.slice(i, step)
                out = [one.decode_packed(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids, the digest of the packed ids and that of the decoded bytes.

    Encoding and decoding happen in one pass, so ids and bytes never leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in arrays.parts(batches, 1):
            texts = arrays.plain_texts(batch.column(1))
            for i, j in arrays.slices(texts, _STEP_BYTES):
                count, ids, decoded = [], [], []
                for packed in one.encode_all(texts[i:j].to_pylist()):
                    count.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(one.decode_packed(packed)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(count, pa.int64()), pa.array(ids), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _two(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
