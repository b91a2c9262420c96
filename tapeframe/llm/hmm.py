"""Language-model scores: a hidden Markov model over words, trained by Baum-Welch over all training texts.

A state emits a word in two steps: a word class, of a fixed number that words fall into by hash, by the
state's own distribution; then the word, by its smoothed share of the class in the training text. The
tables of the model are bounded by states and classes, however many words there are, and the word shares
come from counts of the whole training text, joined by word. The end of a text is a class of its own.

Each round of training sums expected counts over all texts, long ones in segments: partitions add up their own, two levels of
groups add those, one vector of fixed size reaches the driver. A score is the exact log10 likelihood by
the scaled forward recursion over the whole text.

Texts are tokenised once into blocks, stored in the shared folder; rounds read those. Words are counted
per part of the text first, so a word that occurs everywhere is one row for each part.

Defined results: a null text counts as empty and has the end alone; repeated rows are scored alike and
count as often in training; a null doc_id is never held out; without training text the base score of a
token is log10(1) and the model is uniform; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.llm import arrays
from tapeframe.llm.quality import held_out
from tapeframe.session import staged

#: Text of one block, text that shares one vocabulary, and places (steps times texts) of one forward pass.
_BLOCK_BYTES = 2 << 20
_SCOPE_BYTES = 32 << 20
_PASS_PLACES = 200_000

#: Tokens of a segment in training. Scores follow whole texts.
_SEGMENT = 512

#: The hash of the end of a text; no word has it.
_END = np.uint64(0)


@dataclass(frozen=True)
class ModelConfig:
    states: int = 6
    classes: int = 4096
    rounds: int = 6
    smoothing: float = 0.1  #: of word shares, as in the base score
    prior: float = 0.05  #: expected counts added to every transition and emission
    stay: float = 0.95  #: first probability to remain in a state
    folds: int = 10
    seed: int = 3


def symbols_of(words: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word hash; the end's is the last."""
    return np.where(words == _END, classes, (words >> np.uint64(20)) % np.uint64(classes)).astype(np.int64)


class Vocabulary:
    """Words of one scope: a word is its class and its number among the scope's words of that class."""

    def __init__(self, classes: int):
        self.classes = classes
        self.words = np.zeros(0, np.uint64)  # sorted
        self.numbers = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)  # in training texts
        self.sizes = np.zeros(classes + 1, np.int64)
        self.bytes = 0

    def add(self, words: np.ndarray, times: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, number) of distinct sorted words; new ones are numbered by falling frequency."""
        at = np.searchsorted(self.words, words)
        old = at < len(self.words)
        old[old] = self.words[at[old]] == words[old]
        self.counts[at[old]] += train[old]
        new = np.flatnonzero(~old)
        symbol = symbols_of(words, self.classes)
        number = np.zeros(len(words), np.int64)
        number[old] = self.numbers[at[old]]
        order = new[np.lexsort((-times[new], symbol[new]))]
        first = np.searchsorted(symbol[order], np.arange(self.classes + 1))
        number[order] = self.sizes[symbol[order]] + np.arange(len(order)) - first[symbol[order]]
        self.sizes += np.bincount(symbol[new], minlength=self.classes + 1)
        self.words, self.numbers, self.counts = (
            np.insert(mine, at[new], theirs[new]) for mine, theirs in ((self.words, words), (self.numbers, number), (self.counts, train)))
        return symbol, number


_TOKENS = "part long, ids array<long>, held binary, lengths binary, symbols binary, numbers binary, words binary, places binary, counts binary"


def tokenise(docs: DataFrame, config: ModelConfig, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents, and after them the vocabulary they share, in rows of the same table.

    A block has document ids, lengths, and for every token its class (two bytes) and its number in the
    class (as few bytes as it takes). A vocabulary row has word hashes, numbers and training counts. A
    vocabulary serves one part: the blocks of a task, or the next 32 MB of text of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        scope = Vocabulary(config.classes)

        def row(*values) -> pa.RecordBatch:
            types = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 7
            packed = [v.tobytes() if isinstance(v, np.ndarray) else v for v in values]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(packed, types, strict=True)],
                                              names=[c.split()[0] for c in _TOKENS.split(", ")])

        def vocabulary() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(scope.words), 1 << 17):
                cut = slice(lo, lo + (1 << 17))
                yield row(part, None, None, None, None, None, scope.words[cut], scope.numbers[cut].astype(np.int32), scope.counts[cut])

        for batch in arrays.parts(batches, 2, _BLOCK_BYTES):
            if scope.bytes > _SCOPE_BYTES:
                yield from vocabulary()
                part, scope = part + 1, Vocabulary(config.classes)
            texts = arrays.plain_texts(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw, at = arrays.buffers(texts)
            raw = lower[raw]
            scope.bytes += len(raw)
            owner, start, end = arrays.spans(raw, at, arrays.NOT_SPACE)
            key = np.maximum(arrays.span_hashes(raw, start, end), np.uint64(1))
            n = len(batch)
            lengths = np.bincount(owner, minlength=n) + 1
            tokens = np.full(len(key) + n, _END)
            tokens[np.arange(len(key)) + owner] = key
            words, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
            train = np.bincount(token[np.repeat(~held, lengths)], minlength=len(words))
            symbol, number = scope.add(words, times, train)
            top = int(number.max()) if len(number) else 0
            kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
            yield row(part, batch.column(0).to_pylist(), held, lengths.astype(np.int64), symbol.astype(np.uint16)[token], number.astype(kind)[token],
                      None, None, None)
        yield from vocabulary()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id, config.folds).alias("held"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _TOKENS)


def _array(batch, name: str, k: int, kind) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(column[k].as_buffer(), kind)


def _numbers(batch, k: int, tokens: int) -> np.ndarray:
    raw = _array(batch, "numbers", k, np.uint8)
    return raw.view({1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // max(1, tokens) or 1]).astype(np.int64)


def vocabulary_rows(tokens: DataFrame) -> DataFrame:
    """(word, part, place, n): every word of every part with its training count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                words = _array(batch, "words", k, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.array(np.full(len(words), batch.column(0)[k].as_py())), pa.array(_array(batch, "places", k, np.int32)),
                     pa.array(_array(batch, "counts", k, np.int64))], names=["word", "part", "place", "n"])

    return tokens.where("words is not null").select("part", "words", "places", "counts").mapInArrow(run, "word long, part long, place int, n long")


@dataclass
class Model:
    start: np.ndarray  #: states
    move: np.ndarray  #: states x states
    emit: np.ndarray  #: states x (classes + 1)

    def log10(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 likelihood of each text's class sequence: the scaled forward recursion, all texts
        of the block in step."""
        order = np.argsort(-lengths, kind="stable")
        first, length = (np.cumsum(lengths) - lengths)[order], lengths[order]
        alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left").tolist()
        into = np.ascontiguousarray(self.move.T)
        total, now = np.zeros(len(order)), self.start[:, None]
        for t, m in enumerate(alive):
            now = (into @ now[:, :m] if t else now) * np.take(self.emit, symbols[first[:m] + t], axis=1)
            scale = now.sum(0)
            now /= scale
            total[:m] += np.log10(scale)
        out = np.empty(len(order))
        out[order] = total
        return out

    def stationary(self) -> np.ndarray:
        """The share of time spent in each state in the long run."""
        return np.linalg.matrix_power(self.move, 1 << 20).mean(0)

    def expected(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts (starts, moves, emissions) and the log likelihood, as one vector.

        Texts are cut into segments of ``_SEGMENT`` tokens; one that does not begin a text starts from
        the stationary shares and adds no start.
        """
        k, n = len(self.start), -(-lengths // _SEGMENT)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        every_first = np.repeat(np.cumsum(lengths) - lengths, n) + inside * _SEGMENT
        every_length = np.minimum(np.repeat(lengths, n) - inside * _SEGMENT, _SEGMENT)
        order = np.argsort(-every_length, kind="stable")
        start, move, emit, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit), 0.0
        into, later = np.ascontiguousarray(self.move.T), self.stationary()
        i = 0
        while i < len(order):
            steps = int(every_length[order[i]])
            own = order[i:i + max(1, _PASS_PLACES // steps)]
            i += len(own)
            length, begins = every_length[own], inside[own] == 0
            at = np.arange(steps)[:, None]
            real = at < length
            table = symbols[np.where(real, every_first[own] + at, 0)]
            alive = np.searchsorted(-length, -np.arange(steps), "left").tolist()
            emission = np.empty((steps, k, len(own)))
            for s in range(k):
                emission[:, s] = self.emit[s][table]
            state, scale = np.zeros_like(emission), np.ones((steps, len(own)))
            now = np.where(begins, self.start[:, None], later[:, None])
            for t, m in enumerate(alive):
                now = (into @ now[:, :m] if t else now) * emission[t, :, :m]
                scale[t, :m] = now.sum(0)
                now /= scale[t, :m]
                state[t, :, :m] = now
            emission /= scale[:, None]
            back = np.ones((k, len(own)))
            for t in range(steps - 1, 0, -1):
                m = alive[t]
                seen = emission[t, :, :m] * back[:, :m]
                move += state[t - 1, :, :m] @ seen.T
                state[t, :, :m] *= back[:, :m]
                back[:, :m] = self.move @ seen
            state[0] *= back
            start += state[0][:, begins].sum(1)
            flat = table[real]
            for s in range(k):
                emit[s] += np.bincount(flat, state[:, s][real], self.emit.shape[1])
            likelihood += np.log(scale).sum()
        return np.concatenate([start, (move * self.move).ravel(), emit.ravel(), [likelihood]])


def first_model(totals: np.ndarray, config: ModelConfig) -> Model:
    """States that differ at random around the classes' overall shares, and that mostly stay."""
    k = config.states
    random = np.random.default_rng(config.seed)
    emit = (totals + config.prior) * random.uniform(0.2, 1.8, (k, len(totals)))
    move = np.full((k, k), (1 - config.stay) / max(1, k - 1))
    np.fill_diagonal(move, config.stay if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), move, emit / emit.sum(1, keepdims=True))


def train(blocks: DataFrame, totals: np.ndarray, config: ModelConfig) -> Model:
    """Baum-Welch over the training texts of all blocks."""
    model, k = first_model(totals, config), config.states
    for _ in range(config.rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = None
            for batch in batches:
                for i in range(len(batch)):
                    symbol, lengths, held = _array(batch, "symbols", i, np.uint16), _array(batch, "lengths", i, np.int64), _array(batch, "held", i, bool)
                    symbol = symbol[np.repeat(~held, lengths)].astype(np.int64)
                    if len(symbol):
                        v = model.expected(symbol, lengths[~held])
                        total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["shard", "v"])

        got = arrays.merge_sums(blocks.select("held", "lengths", "symbols").mapInArrow(run, "shard int, v binary"), []).collect()
        if not got:
            return model
        v = np.frombuffer(bytes(got[0].v), np.float64)[:-1] + config.prior
        share = lambda x: x / x.sum(-1, keepdims=True)
        model = Model(share(v[:k]), share(v[k:k + k * k].reshape(k, k)), share(v[k + k * k:].reshape(k, -1)))
    return model


def score(docs: DataFrame, config: ModelConfig = ModelConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    tokens = staged(tokenise(docs, config, doc_id, text), "tokens")
    blocks = tokens.where("lengths is not null")
    # A word has one row for each part, so its rows here are at most as many as there are parts.
    word = Window.partitionBy("word")
    symbol = F.when(F.col("word") == 0, config.classes).otherwise(
        F.pmod(F.shiftrightunsigned("word", 20), F.lit(config.classes).cast("long"))).cast("int")
    counts = staged(vocabulary_rows(tokens).select(
        "part", symbol.alias("symbol"), "place", F.sum("n").over(word).alias("c"), (F.row_number().over(word.orderBy("part")) == 1).alias("once")
    ).where("c > 0"), "counts")
    totals, kinds = np.zeros(config.classes + 1), np.zeros(config.classes + 1)
    for r in counts.where("once").groupBy("symbol").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        totals[r.symbol], kinds[r.symbol] = r.c, r.v
    model = train(blocks, totals, config)
    every, distinct, alpha = int(totals.sum()), int(kinds.sum()), config.smoothing

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known_class, known_place = right.column("symbol").to_numpy().astype(np.int64), right.column("place").to_numpy().astype(np.int64)
        sizes = np.zeros(config.classes + 2, np.int64)
        np.maximum.at(sizes, known_class, known_place + 1)
        sizes[:-1] += 1  # the last place of each class stands for words that are not known
        first = np.cumsum(sizes) - sizes
        c = np.zeros(sizes.sum())
        c[first[known_class] + known_place] = right.column("c").to_numpy()
        own = np.repeat(np.arange(len(sizes)), sizes)
        base = np.log10((c + alpha) / (every + alpha * (distinct + 1)))
        of = np.minimum(own, config.classes)
        inside = np.where(own >= config.classes, 0.0, np.log10((c + alpha) / (totals[of] + alpha * (kinds[of] + 1))))
        out = []
        for batch in left.to_batches():
            for k in range(len(batch)):
                lengths, held = _array(batch, "lengths", k, np.int64), _array(batch, "held", k, bool)
                classes = _array(batch, "symbols", k, np.uint16).astype(np.int64)
                at = first[classes] + np.minimum(_numbers(batch, k, len(classes)), sizes[classes] - 1)
                begin = np.cumsum(lengths) - lengths
                out.append(pa.table([
                    batch.column(batch.schema.get_field_index("ids")).slice(k, 1).flatten(), pa.array(held), pa.array(lengths),
                    pa.array(np.add.reduceat((c[at] > 0).astype(np.int64), begin)), pa.array(np.full(len(lengths), every)),
                    pa.array(np.add.reduceat(base[at], begin)), pa.array(np.add.reduceat(inside[at], begin) + model.log10(classes, lengths))],
                    names=[n for n, _ in _SCORE]))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in _SCORE})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return (blocks.select("part", "ids", "held", "lengths", "symbols", "numbers").groupBy("part")
            .cogroup(counts.select("part", "symbol", "place", "c").groupBy("part")).applyInArrow(run, schema))


_SCORE = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
          ("base_score", pa.float64()), ("score", pa.float64()))
