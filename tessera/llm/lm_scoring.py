"""Language-model scoring by a log-bilinear neural model, trained in numpy with
noise-contrastive estimation.

Token counts of the training documents are gathered over the whole corpus, by an
exchange of distinct token hashes per chunk. The N_WORDS most frequent words are
classes of their own, all others are classes by the hash of their first bytes; the
end of a text is a class too. A token of a shared class has the class's probability
times its smoothed share of the class's count, so the probabilities of all tokens,
those unseen of a class together, add to one.

Training is in two rounds, both on counts over all training tokens, so that it costs
the same on any corpus once these are summed, and scores do not depend on how rows
fall into partitions. First, how often each coarse class stands within NEAR words
before each other one: the model fitted to it gives context vectors, whose clusters
are the topics. Second, how often each class follows each context, which is the pair
of the topic most frequent among the last WIDE words and that of the last word. The
model predicts a class from the sum of the two places' context vectors, times the
class's vector, plus its bias. There are finitely many contexts, so the noise's share
of the objective is taken in full instead of by draws, and one matrix product
normalises the probabilities of all classes after each context exactly.

Nulls: a null text is the end token alone; a null doc_id counts as empty text for
the fold. Repeated rows count as often as they are there. Without training tokens
all counts are 0. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import Rolling, byte_codes, owner, word_spans

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = np.uint64(0x5BD1E995C0FFEE11)
#: Words with a class of their own, also in the first round; classes of all others.
N_WORDS, COARSE_WORDS, N_PREFIX, PREFIX_BYTES = 8192, 512, 1024, 3
NEAR, WIDE, TOPICS = 4, 16, 16
#: The model: size of vectors, noise samples for each token, steps of training.
DIM, NOISE, STEPS = 24, 64, 120
#: Contexts: topic and last word's topic; one more of each begins a text.
CONTEXTS = (TOPICS + 1) ** 2
_SHARED = np.dtype([("total", np.int64), ("types", np.int64)])


def held_out(ids: np.ndarray, nulls: np.ndarray, folds: int = 5, fold: int = 1) -> np.ndarray:
    return np.array([zlib.crc32(b"" if z else b"%d" % i) % folds == fold for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)], bool)


class Tokens:
    """A chunk's tokens in text order, an end after each text."""

    def __init__(self, chunk: C.Chunk):
        data = chunk.data + np.where((chunk.data >= 65) & (chunk.data <= 90), np.uint8(32), np.uint8(0))
        start, end = word_spans(data, chunk.off)
        doc = owner(chunk.off, start)
        n = len(chunk.ids)
        words = np.bincount(doc, minlength=n)
        self.stop = np.cumsum(words + 1)  # behind each text's end token
        self.key = np.empty(len(start) + n, np.uint64)
        rolling = Rolling(byte_codes(data))
        self.key[np.arange(len(start)) + doc] = rolling.of(start, end)
        self.key[self.stop - 1] = END
        self.prefix = np.zeros(len(self.key), np.uint16)
        first = rolling.of(start, np.minimum(end, start + PREFIX_BYTES))
        self.prefix[np.arange(len(start)) + doc] = first % np.uint64(N_PREFIX)
        self.doc = np.repeat(np.arange(n), words + 1)
        self.held = held_out(chunk.ids, chunk.nulls)

    def ranks(self, vocab: Vocabulary) -> np.ndarray:
        """Each token's place among the most frequent words, -1 for all others."""
        at = np.minimum(np.searchsorted(vocab.key, self.key), max(len(vocab.key) - 1, 0))
        return np.where(vocab.key[at] == self.key, vocab.rank[at], -1) if len(vocab.key) else np.full(len(self.key), -1)

    def classes(self, vocab: Vocabulary, words: int) -> np.ndarray:
        """The words most frequent ones by rank, then the shared classes, then the end."""
        rank = self.ranks(vocab)
        cls = np.where((rank >= 0) & (rank < words), rank, words + self.prefix.astype(np.int64))
        cls[self.stop - 1] = words + N_PREFIX
        return cls

    def contexts(self, topic: np.ndarray) -> np.ndarray:
        """Each token's context, from the topics of the tokens of its text."""
        n = len(topic)
        at = np.arange(n)
        begin = np.repeat(np.concatenate([[0], self.stop[:-1]]), np.diff(self.stop, prepend=0))
        low = np.maximum(begin, at - WIDE)
        best = np.zeros(n, np.int32)  # count and topic; of equal counts the lower topic
        for k in range(TOPICS):
            sums = np.concatenate([[0], np.cumsum(topic == k, dtype=np.int32)])
            np.maximum(best, (sums[at] - sums[low]) * TOPICS + (TOPICS - 1 - k), out=best)
        wide = TOPICS - 1 - best % TOPICS
        last = np.concatenate([topic[:1], topic[:-1]])
        first = at == begin
        return np.where(first, TOPICS, wide) * (TOPICS + 1) + np.where(first, TOPICS, last)


@dataclass
class Vocabulary:
    """The most frequent words: sorted hashes and the rank of each."""

    key: np.ndarray
    rank: np.ndarray


def fit(counts: np.ndarray, places: list[np.ndarray], dim: int = DIM, noise: int = NOISE, steps: int = STEPS, seed: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """A log-bilinear model of counts (contexts by classes) by noise-contrastive
    estimation: contexts are told from noise drawn by the classes' frequencies, noise
    samples for each token. places gives, for each place of a context, its row in that
    place's table. Returns the tables and log probabilities, normalised by context."""
    total = counts.sum(0, dtype=np.float64) + 0.5
    p = (total / total.sum()).astype(np.float32)
    weight = (counts + 10 * p).astype(np.float32)  # rare contexts lean to the frequencies
    weight /= weight.sum(dtype=np.float64)
    against = weight.sum(1, keepdims=True) * (noise * p)
    log_noise = np.log(noise * p)
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.1, (at.max() + 1, dim)).astype(np.float32) for at in places]
    out, bias, own = rng.normal(0, 0.1, (len(p), dim)).astype(np.float32), np.log(p), np.zeros((len(counts), 1), np.float32)
    values = [*tables, out, bias, own]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1 if counts.any() else 1):
        hidden = sum(t[at] for t, at in zip(tables, places, strict=True))
        z = hidden @ out.T
        z += bias - log_noise + own
        is_noise = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        g = (weight + against) * is_noise - against
        back = g @ out
        slopes = []
        for t, at in zip(tables, places, strict=True):
            slopes.append(np.zeros_like(t))
            np.add.at(slopes[-1], at, back)
        slopes += [g.T @ hidden, g.sum(0), g.sum(1, keepdims=True)]
        rate = 0.1 * min(1, 2 * (1 - (step - 1) / steps))
        for v, s, a, b in zip(values, slopes, first, second, strict=True):
            a += 0.1 * (s - a)
            b += 0.01 * (s * s - b)
            v += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-12)
    z = sum(t[at] for t, at in zip(tables, places, strict=True)) @ out.T + bias
    z -= z.max(1, keepdims=True)
    return tables, z - np.log(np.exp(z).sum(1, keepdims=True))


def cluster(vectors: np.ndarray, weight: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """The k-means cluster of each vector."""
    rng = np.random.default_rng(seed)
    centers = vectors[[int(weight.argmax())]]
    for _ in range(k - 1):
        far = ((vectors[:, None] - centers[None]) ** 2).sum(2).min(1) * weight
        pick = rng.choice(len(vectors), p=far / far.sum()) if far.sum() > 0 else 0
        centers = np.concatenate([centers, vectors[[pick]]])
    for _ in range(30):
        own = ((vectors[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        for c in range(k):
            if weight[own == c].sum() > 0:
                centers[c] = np.average(vectors[own == c], axis=0, weights=weight[own == c])
    return own


def _sum_counts(arrays: list[np.ndarray], source: np.ndarray):
    key, count, prefix = arrays
    order, begin = C.groups(key)
    if not len(order):
        return [np.zeros(0, np.int64)]
    total = np.add.reduceat(count[order].astype(np.int64), begin)
    known = total > 0
    own, cls = key[order][begin], prefix[order][begin].astype(np.int64)
    word = known & (own != END)
    best = np.lexsort((own[word], -total[word]))[:N_WORDS]
    shared = [np.bincount(cls[word], w, N_PREFIX).astype(np.int64) for w in (total[word], None)]
    sums = np.array([known.sum(), total.sum(), total[own == END].sum()], np.int64)
    return [C.spread(total, order, begin)], [sums, own[word][best], total[word][best], cls[word][best], *shared]


def _gather(replies: DataFrame) -> tuple[int, int, Vocabulary, np.ndarray]:
    """Distinct tokens, all tokens, the most frequent words, and the counts and distinct
    words of the shared classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                sums, key, count, cls, total, types = C.unsqueeze(payload)
                # Words, sums of shared classes, sums of all.
                kind = np.repeat([0, 1, 2], [len(key), N_PREFIX, len(sums)]).astype(np.int32)
                cols = [np.concatenate(x) for x in ([key.view(np.int64), np.arange(N_PREFIX), np.arange(len(sums))], [count, total, sums], [cls, types, sums])]
                yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, cols)], ["kind", "key", "n", "m"])

    rows = replies.where("chunk_id = -1").select("payload").mapInArrow(run, "kind int, key long, n long, m long")
    shared, sums = np.zeros(N_PREFIX, _SHARED), np.zeros(3, np.int64)
    for r in rows.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect():  # of fixed size
        if r.kind == 1:
            shared[r.key] = (r.n, r.m)
        else:
            sums[r.key] = r.n
    best = rows.where("kind = 0").orderBy(F.desc("n"), "key").limit(N_WORDS).toArrow()
    key, n, cls = (best.column(c).to_numpy() for c in ("key", "n", "m"))
    np.subtract.at(shared["total"], cls, n)
    np.subtract.at(shared["types"], cls, 1)
    order = np.argsort(key.view(np.uint64), kind="stable")
    return int(sums[0]), int(sums[1]), Vocabulary(key.view(np.uint64)[order], order), shared


def _cells(packed: DataFrame, shape: tuple[int, int], find: Callable) -> DataFrame:
    """Counts of the cells (row, column) that find(tokens) gives as flat numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shape[0] * shape[1], np.int64)
        for chunk in C.chunks_of(batches):
            for cells in find(Tokens(chunk)):
                counts += np.bincount(cells, minlength=len(counts))
        cell = np.flatnonzero(counts)
        for s in range(0, len(cell), 1 << 17):
            at = cell[s : s + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["cell", "n"])

    return packed.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _fitted(cells: DataFrame, shape: tuple[int, int], make: Callable) -> np.ndarray:
    """What make(counts) gives, made by one task from the summed counts (of fixed size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shape[0] * shape[1], np.float32)
        for batch in batches:
            counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([C.squeeze(make(counts.reshape(shape)))], pa.binary())], ["made"])

    row = cells.repartition(1).mapInArrow(run, "made binary").first()
    return C.unsqueeze(bytes(row[0]))[0] if row else make(np.zeros(shape, np.float32))  # Spark drops the task of an empty table


def topics(packed: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """The topic of each coarse class."""
    n = COARSE_WORDS + N_PREFIX + 1

    def find(t: Tokens) -> Iterator[np.ndarray]:
        cls = t.classes(vocab, COARSE_WORDS)
        own = ~t.held[t.doc]
        for k in range(1, NEAR + 1):
            both = own[k:] & (t.doc[k:] == t.doc[:-k])
            yield (cls[:-k] * n + cls[k:])[both]

    def make(counts: np.ndarray) -> np.ndarray:
        (vectors,), _ = fit(counts, [np.arange(n)])
        return cluster(vectors, np.sqrt(counts.sum(1)), TOPICS).astype(np.int8)

    return _fitted(_cells(packed, (n, n), find), (n, n), make)


def probabilities(packed: DataFrame, vocab: Vocabulary, topic: np.ndarray) -> np.ndarray:
    """Normalised log probability of each class after each context."""
    shape = (CONTEXTS, N_WORDS + N_PREFIX + 1)

    def find(t: Tokens) -> Iterator[np.ndarray]:
        own = ~t.held[t.doc]
        context = t.contexts(topic[t.classes(vocab, COARSE_WORDS)])
        yield (context * shape[1] + t.classes(vocab, N_WORDS))[own]

    def make(counts: np.ndarray) -> np.ndarray:
        return fit(counts, list(np.divmod(np.arange(CONTEXTS), TOPICS + 1)))[1].astype(np.float32).ravel()

    return _fitted(_cells(packed, shape, find), shape, make).reshape(shape)


def score_texts(docs: DataFrame) -> DataFrame:
    """Columns as in RESULT; base_score and score are log10 probabilities of the text."""
    packed = C.pack(docs)
    bits = C.buckets_for(packed, 16 << 20)

    def ask(chunk: C.Chunk, _):
        t = Tokens(chunk)
        key, first, back = np.unique(t.key, return_index=True, return_inverse=True)
        return key, [key, np.bincount(back, ~t.held[t.doc], len(key)).astype(np.uint32), t.prefix[first]]

    counts = C.reply(C.requests(packed, ask, bits), 0, _sum_counts, "token-counts")
    distinct, total, vocab, shared = _gather(counts)
    topic = topics(packed, vocab)
    # Of fixed size.
    model = docs.sparkSession.sparkContext.broadcast((vocab, shared, topic, probabilities(packed, vocab, topic)))

    def result(chunk: C.Chunk, answers: dict) -> dict:
        vocab, shared, topic, table = model.value
        t = Tokens(chunk)
        n = len(chunk.ids)
        _, back = np.unique(t.key, return_inverse=True)
        c = answers[0][0][back] if 0 in answers else np.zeros(len(t.key), np.int64)
        cls = t.classes(vocab, N_WORDS)
        own = table[t.contexts(topic[t.classes(vocab, COARSE_WORDS)]), cls] / np.log(10)
        at = np.flatnonzero((cls >= N_WORDS) & (cls < N_WORDS + N_PREFIX))
        rest = shared[cls[at] - N_WORDS]
        own[at] += np.log10((c[at] + 0.5) / (rest["total"] + 0.5 * (rest["types"] + 1)))
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        return {
            "doc_id": chunk.id_column(),
            "held_out": pa.array(t.held),
            "n_tokens": pa.array(np.bincount(t.doc, minlength=n), pa.int64()),
            "n_known": pa.array(np.bincount(t.doc[c > 0], minlength=n), pa.int64()),
            "train_tokens": pa.array(np.full(n, total), pa.int64()),
            "base_score": pa.array(np.bincount(t.doc, base, n)),
            "score": pa.array(np.bincount(t.doc, own, n)),
        }

    return C.finish(packed, counts.where("chunk_id >= 0"), result, RESULT)
