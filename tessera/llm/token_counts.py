"""Token counts by the whole-token shortcut, for sentencepiece BPE models whose
normaliser leaves texts as they are.

No piece of such a model holds a word mark (the escaped space) after another
character, so no merge crosses the place where a run of marks begins: a text is
cut there into pre-tokens that encode independently. Before any text is seen,
every piece that is such a pre-token is encoded alone; those that come back as
one token form the shortcut. Pre-tokens found there count 1; only the rest is
merged by the library, once for each distinct pre-token a worker still remembers.

Nulls and empty texts have 0 bytes and 0 tokens. Texts are never cut or padded;
strings that look like special tokens are ordinary text. Each row gets its own
count, repeated rows too; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches

MARK = "▁"


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens proven to encode alone as one token, without their leading
    mark (which the library puts before every text). Raises where a piece breaks
    the rule that pre-tokens rest on."""
    sp = load(path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    plain = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not special(i)]
    for _, piece in plain:
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} joins two pre-tokens")
    if sp.encode(" a  b") == sp.encode("a b"):
        raise ValueError("the model's normaliser drops spaces")
    marked = [(i, p[1:]) for i, p in plain if p[0] == MARK]
    return frozenset(p for (i, p), got in zip(marked, sp.encode([p for _, p in marked]), strict=True) if got == [i])


class Counter(dict):
    """Tokens of a pre-token, its leading mark left out. Starts from the shortcut,
    asks the library for the rest, and forgets what it learnt beyond `most`."""

    def __init__(self, path: str, whole: frozenset[str], most: int = 400_000):
        super().__init__(dict.fromkeys(whole, 1))
        self.sp, self.whole, self.most = load(path), whole, most

    def __missing__(self, rest: str) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        # The library puts no mark before an empty text; a lone mark is one piece, or its three bytes.
        n = len(self.sp.encode(rest)) if rest else 1 if self.sp.piece_to_id(MARK) != self.sp.unk_id() else 3
        self[rest] = n
        return n

    def count(self, text: str) -> int:
        """Cut at every space that follows another character than a space. A run of
        spaces stays with the word behind it, less the one mark that begins it."""
        if not text:
            return 0
        parts = text.replace(MARK, " ").split(" ") if MARK in text else text.split(" ")
        if "" not in parts:
            return sum(map(self.__getitem__, parts))
        total, gap = 0, 0
        for k, part in enumerate(parts):
            if part:
                total += self[" " * gap + part]
                gap = 0
            elif k == len(parts) - 1:
                total += self[" " * gap]
            else:
                gap += 1
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([counter.count(t or "") for t in texts], pa.int64()), batch.column(2)],
                ["doc_id", "n_tokens", "n_bytes"],
            )

    small_batches(docs.sparkSession)
    sized = id_text(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = sized.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
