"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at safe boundaries, which no token of a byte-level BPE can cross: before a single space
between two characters that aren't white space, and around a single line feed between two such. The count
of a text is the sum over its pieces. Pieces seen before are looked up in a bounded memo; new ones are
encoded in batches that hold about equal numbers of bytes, so one very long text never makes a batch of
its own size and a batch of short ones isn't mostly overhead. Only lengths come back.

Nulls: a null text is empty and has 0 tokens; a null doc_id is counted like any other. Repeated rows are counted each for itself, an empty table
gives an empty result, extra columns of any name aren't read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of an encoding batch.
BATCH_BYTES = 1 << 18
#: Pieces kept in a worker's memo, and the longest of them.
MEMO_PIECES, MEMO_CHARS = 600_000, 48

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"[^\S \n]|  | \n|\n |\n\n|^\s|\s$")


def tokenizer(name: str = TOKENIZER):
    """The tokenizer of a file name, looked up among the installed vocabularies, or of a path."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def pieces(text: str) -> list[str]:
    """Parts of a text that are tokenized apart.

    A part without leading white space follows a space that belongs to it, but for the first part; a part
    that begins with a line feed has no space before it.
    """
    if _ODD.search(text):  # white space that needs its neighbours: cut elsewhere only
        return _SAFE.split(text)
    return text.replace("\n", " \n").split(" ")


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def batches(parts: list[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about equal bytes; longer parts first, so that padding to the longest is small."""
    batch, held = [], 0
    for p in sorted(parts, key=len, reverse=True):
        batch.append(p)
        held += n_bytes(p)
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Counter:
    """Counts tokens of texts; keeps the counts of pieces."""

    def __init__(self, name: str = TOKENIZER):
        self.tokenizer, self.memo = tokenizer(name), {}

    def _learn(self, keys: set[str]) -> dict[str, int]:
        """Counts of new pieces. A key without leading white space stands for the piece with its space."""
        new = {}
        for batch in batches(list(keys)):
            real = [k if k[:1] == "\n" else " " + k for k in batch]
            for k, e in zip(batch, self.tokenizer.encode_batch_fast(real, add_special_tokens=False), strict=True):
                new[k] = len(e)
        return new

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        memo, split = self.memo, [pieces(t) for t in texts]
        keys = set()
        for p in split:
            keys.update(p[1:])
        learned = self._learn(keys.difference(memo))
        memo.update((k, n) for k, n in learned.items() if len(k) <= MEMO_CHARS)
        long = {k: n for k, n in learned.items() if len(k) > MEMO_CHARS}
        head = {}
        for batch in batches(list({p[0] for p in split})):
            head.update(zip(batch, map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
        if long:
            return [head[p[0]] + sum(long[k] if k in long else memo[k] for k in p[1:]) for p in split]
        return [head[p[0]] + sum(map(memo.__getitem__, p[1:])) for p in split]


_HELD: dict[str, Counter] = {}


def held(name: str) -> Counter:
    """The tokenizer and memo of this worker process, which later tasks use as well."""
    if name not in _HELD:
        _HELD[name] = Counter(name)
    return _HELD[name]


def _by_bytes(texts: pa.Array, size: int) -> Iterator[tuple[list[str], list[int]]]:
    """Texts, and their bytes, in lots of about ``size`` bytes; only one lot is held as Python strings."""
    lot, held, total = [], [], 0
    for t in texts:
        lot.append(t.as_py())
        held.append(n_bytes(lot[-1]))
        total += held[-1]
        if total >= size:
            yield lot, held
            lot, held, total = [], [], 0
    if lot:
        yield lot, held


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(name)
        for b in common.lots(it):
            n, size = [], []
            for lot, held_bytes in _by_bytes(b.column("text"), 4 * BATCH_BYTES):
                n += counter.counts(lot)
                size += held_bytes
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return count_tokens(common.documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
