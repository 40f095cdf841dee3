"""Lexical retrieval packing: a sharded BM25 index fills each window with the seed's unused neighbours.

Documents are tokenized once into a table of 16-bit ids. Document frequencies of the vocabulary's tokens are
counted over all documents (at most one row a token, so the table that every task gets is bounded by the
vocabulary). Documents are ordered by their two leading terms (count and rarity) and cut into shards of ``SHARD_ROWS``, so that
related ones meet; each shard builds an inverted index of BM25 weights and is searched by its own seeds only. The next seed is the document that the last window cut, else the first unused one;
its highest-weighted terms retrieve the unused documents, best first, which fill the window. Documents
follow one another without a gap and are cut at every 4096 ids; what a shard leaves over is cut into powers of two, so
no sequence is padded at all.

Nulls: a null text is empty and has the end id alone. A null doc_id is packed like any other. Repeated rows
are packed each for itself, in as many shards as they need. Ties in score go to the earlier document of the shard. An empty table
gives an empty result; extra columns of any name aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_ids

TOKENIZER, END = "word_bpe_49k.json", 2
WINDOW = 4096
#: Documents and ids of a shard, at most (a longer document is a shard), and shards that one task packs in turn.
SHARD_ROWS, SHARD_IDS, PART_SHARDS = 768, 1 << 22, 8
#: Terms of a seed that retrieve, and the usual constants of BM25.
QUERY_TERMS, K1, B = 24, 1.2, 0.75
VOCABULARY = 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, end: int = END) -> DataFrame:
    """(doc_id, ids, n): the document's ids and the end id, as little-endian 16-bit numbers."""
    last = np.uint16(end).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids.held(name)
        for b in common.lots(it):
            # a lot holds few rows at a time as ids: long texts are taken one by one
            ids = [words.ids(t.as_py()) + last for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], ["doc_id", "ids", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n long")


def term_counts(joined: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, tf) of the ids of fewer than 65,536 documents that follow one another, by document and term."""
    key = np.repeat(np.arange(len(sizes), dtype=np.uint32) << 16, sizes) | joined
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return (key[first] >> 16).astype(np.int64), (key[first] & 0xFFFF).astype(np.int64), np.diff(np.append(first, len(key)))


def _counted(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`term_counts` of a lot's ids, so that the steps of numpy are few for many short documents."""
    own = ids.to_pylist()
    return term_counts(np.frombuffer(b"".join(own), "<u2"), np.array([len(x) // 2 for x in own], np.int64))


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many documents each id occurs, over all rows (ids)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(VOCABULARY, np.int64)
        for b in common.lots(it):
            df += np.bincount(_counted(b.column("ids"))[1], minlength=VOCABULARY)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


class Index:
    """BM25 weights of a shard's documents, by document and by term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs])
        doc, term, tf = term_counts(np.concatenate(docs), sizes)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.terms, self.weights, self.ends = term, weight, np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.posted, self.posted_weights = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, seed: int) -> np.ndarray:
        own = slice(self.ends[seed], self.ends[seed + 1])
        terms, weights = self.terms[own], self.weights[own]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argsort(-weights, kind="stable")[:QUERY_TERMS]]
        out = np.zeros(self.n)
        for t in terms:
            at = slice(self.starts[t], self.starts[t + 1])
            out[self.posted[at]] += self.posted_weights[at]
        return out


def retrieval_order(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[int]:
    """The order in which a shard's documents fill its windows."""
    index, unused = Index(docs, idf, mean), np.ones(len(docs), bool)
    order, room, seed, first = [], 0, -1, 0
    while len(order) < len(docs):
        if room == 0 or seed < 0:  # a window ended with a document's end: the next seed is the first unused one
            while not unused[first]:
                first += 1
            seed = first
            order.append(seed)
            unused[seed] = False
            room = (room - len(docs[seed])) % window
            continue
        rest = np.flatnonzero(unused)
        for d in rest[np.argsort(-index.scores(seed)[rest], kind="stable")]:
            order.append(int(d))
            unused[d] = False
            size = len(docs[d])
            if size >= room:  # cut (or just full): what is left of it seeds the next window
                seed, room = int(d), (room - size) % window
                break
            room -= size
    return order


def cuts(total: int, window: int = WINDOW) -> np.ndarray:
    """Where sequences begin and end: whole windows, then falling powers of two."""
    ends = list(range(0, total + 1, window))
    left = total - ends[-1]
    while left:
        part = 1 << (left.bit_length() - 1)
        ends.append(ends[-1] + part)
        left -= part
    return np.array(ends, np.int64)


def packed(docs: list[np.ndarray], order: list[int], window: int = WINDOW) -> pd.DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, sequence, offset) of the pieces of documents in this order."""
    sizes = np.array([len(docs[d]) for d in order], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    ends = cuts(int(begin[-1]), window)
    points = np.union1d(begin, ends)
    at, length = points[:-1], np.diff(points)
    k, sequence = np.searchsorted(begin, at, side="right") - 1, np.searchsorted(ends, at, side="right") - 1
    start = at - begin[k]
    crc = [zlib.crc32(docs[order[i]][s : s + n].astype("<u4").tobytes()) for i, s, n in zip(k, start, length, strict=True)]
    return pd.DataFrame({"doc": np.array(order)[k], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": sizes[k], "sequence": sequence, "offset": at - ends[sequence]})


def _heaviest(doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Where each document's greatest weight stands first; documents are numbered from 0 and follow one another."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    at = np.flatnonzero(weight == np.maximum.reduceat(weight, starts)[doc])
    return at[np.flatnonzero(np.diff(doc[at], prepend=-1))]


def leading(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """Rows (..., ids) with first and second: the two terms that weigh most in a document, by their counts and how rare they are."""
    held = rows.sparkSession.sparkContext.broadcast(idf)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lots(it):
            doc, term, tf = _counted(b.column("ids"))
            weight = held.value[term] * tf * (K1 + 1) / (tf + K1)
            first = _heaviest(doc, weight)
            left = weight.copy()
            left[first] = -np.inf
            second = np.where(np.bincount(doc) > 1, _heaviest(doc, left), first)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(term[at], pa.int32()) for at in (first, second))], [*b.schema.names, "first", "second"])

    return rows.mapInArrow(run, "doc_id long, ids binary, n long, row long, first int, second int")


def _shards(frames: Iterator[pd.DataFrame], most_rows: int, most_ids: int) -> Iterator[pd.DataFrame]:
    """The rows that come, cut into shards of so many rows or ids; each is sorted."""
    held, rows, ids = [], 0, 0
    for pdf in frames:
        ends = np.cumsum(pdf["n"].to_numpy())
        at = 0
        while at < len(pdf):
            room = most_ids - ids + (ends[at - 1] if at else 0)
            to = min(at + max(1, int(np.searchsorted(ends[at:], room, "right"))), at + most_rows - rows, len(pdf))
            held.append(pdf.iloc[at:to])
            rows, ids, at = rows + to - at, ids + int(pdf["n"].iloc[at:to].sum()), to
            if rows >= most_rows or ids >= most_ids:
                yield pd.concat(held, ignore_index=True)
                held, rows, ids = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents; see :data:`PIECES`."""
    rows = common.store(tokenized(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    n, total = rows.agg(F.count("*"), F.sum("n")).first()
    df, mean = document_frequencies(rows), (total or 1) / max(n, 1)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for k, pdf in enumerate(_shards(it, SHARD_ROWS, SHARD_IDS)):
            pdf = pdf.sort_values(["doc_id", "n", "row"], kind="stable", ignore_index=True)
            docs = [np.frombuffer(x, "<u2") for x in pdf["ids"]]
            out = packed(docs, retrieval_order(docs, idf, mean))
            out["doc_id"] = pdf["doc_id"].astype("Int64").to_numpy()[out["doc"]]
            out["sequence_id"] = (np.int64(part) << 40) + (np.int64(k) << 24) + out["sequence"]
            yield out[names]

    # documents with the same leading terms come to one shard; the hash spreads those of one term over as many shards as they need
    order = ["first", "second", F.xxhash64("doc_id", "row")]
    parts = common.buckets(n, SHARD_ROWS * PART_SHARDS)
    near = leading(rows, idf).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return near.select("doc_id", "ids", "n", "row").mapInPandas(run, PIECES)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return pack(common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return pack(docs)
