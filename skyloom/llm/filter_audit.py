"""Filter interaction audit: what each of five quality filters removes, in every order, by itself and together.

Texts are scanned where they lie in Arrow's buffers: a table of byte classes marks white space, capitals, symbols and first bytes of
code points, prefix sums over the marks give each document's counts at once. Words are hashed by prefix sums as well; sorted
hashes bring equal words of a document together, and their bytes are compared, so distinct counts are exact whatever the
hashes do. Each document becomes one mask of the filters that it fails. Masks are counted by part, and the counts alone
are applied to the 120 orders, so no order costs another pass over the documents.

Copies are told by SHA-256 of the whole text over the whole table. Counts are grouped by text and part before the copies of
one text meet, so a text that a third of all rows holds moves as a row for each part and label.

Null texts are empty texts, a null source is the part ''. Rows without an id are copies of nothing and have no label; rows with
one id count each. Of several labels of an id any with the value 1 counts. Very long texts are scanned in pieces that end at white space. An empty table gives an empty
result. Extra columns of any name aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
#: A document is to have this many words, this share of distinct ones, and at most this share of capitals, in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Bytes that are scanned at a time.
PIECE = 1 << 20

_SPACE, _CAPITAL, _SYMBOL, _FIRST = 1, 2, 4, 8


def _classes() -> np.ndarray:
    """For each byte value, the classes that it is in."""
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] |= _SPACE
    out[ord("A") : ord("Z") + 1] |= _CAPITAL
    out[list(SYMBOLS)] |= _SYMBOL
    out[[b for b in range(256) if b & 0xC0 != 0x80]] |= _FIRST
    return out


CLASSES = _classes()
#: Base of the word hashes, odd and so invertible modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """Powers of the base, kept by the worker."""
    size = max(PIECE + 1, 1 << int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        p = np.full(size, BASE, np.uint64)
        p[0] = 1
        _POWERS[size] = np.multiply.accumulate(p)
    return _POWERS[size][:n]


def _between(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks lie between two neighbouring ends."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(total[ends])


def _words(data: np.ndarray, space: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of all words; a document's end ends a word."""
    open_ = ~space
    first = open_.copy()
    first[1:] &= space[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = open_[cuts]
    last = open_.copy()
    last[:-1] &= space[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] |= open_[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of bytes at ``a`` and at ``b`` are equal, each of its own size."""
    if not len(a):
        return np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(at[-1]) - np.repeat(at[:-1], size)
    return np.add.reduceat((data[np.repeat(a, size) + step] != data[np.repeat(b, size) + step]).astype(np.int64), at[:-1]) == 0


def distinct_words(data: np.ndarray, space: np.ndarray, ends: np.ndarray, hashed=None) -> tuple[np.ndarray, list[list[tuple[int, int]]] | None]:
    """For each document the number of its words and of its distinct words, and where one of each stands, as (start, end, document).

    hashed: another hash of (start, end), for tests.
    """
    start, end, doc = _words(data, space, ends)
    if hashed is None:
        power = _powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        # what is left of a start's power is undone by the power that would bring all starts to one place
        h = (total[end] - total[start]) * power[::-1][start]
    else:
        h = hashed(start, end)
    size = end - start
    order = np.lexsort((size, h, doc))
    start, size, h, doc = start[order], size[order], h[order], doc[order]
    alike = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1]) & (size[1:] == size[:-1])
    pair = np.flatnonzero(alike)
    equal = np.zeros(len(start), bool)
    equal[pair + 1] = _same(data, start[pair], start[pair + 1], size[pair])
    new = ~equal
    false = np.flatnonzero(alike & ~equal[1:])
    if len(false):
        # words of one hash that aren't one word: each run of that hash is told apart by its bytes
        run = np.concatenate([[0], np.cumsum(~alike)])
        for r in np.unique(run[false]):
            seen = set()
            for k in range(*np.searchsorted(run, [r, r + 1])):
                word = data[start[k] : start[k] + size[k]].tobytes()
                new[k] = word not in seen
                seen.add(word)
    return np.bincount(doc, minlength=len(ends) - 1), np.bincount(doc[new], minlength=len(ends) - 1), (start[new], start[new] + size[new])


def _scan(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each document of a stretch of bytes."""
    kind = CLASSES[data]
    words, distinct, _ = distinct_words(data, (kind & _SPACE) > 0, ends)
    return [words, distinct, *[_between((kind & c) > 0, ends) for c in (_CAPITAL, _FIRST, _SYMBOL)]]


def _scan_long(data: np.ndarray) -> list[int]:
    """The same of one long document, a piece at a time; pieces end at white space, unless a word is longer than a piece."""
    at, counts, seen = 0, np.zeros(4, np.int64), set()
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(CLASSES[data[max(at, end - PIECE) : end]] & _SPACE)
            if len(gaps):
                end = max(at, end - PIECE) + int(gaps[-1]) + 1
                break
            end = min(end + PIECE, len(data))
        part = data[at:end]
        kind = CLASSES[part]
        words, _, (start, stop) = distinct_words(part, (kind & _SPACE) > 0, np.array([0, len(part)]))
        seen.update(part[a:b].tobytes() for a, b in zip(start, stop, strict=True))
        counts += [int(words[0]), *[int(np.count_nonzero(kind & c)) for c in (_CAPITAL, _FIRST, _SYMBOL)]]
        at = end
    return [int(counts[0]), len(seen), *map(int, counts[1:])]


def masks(words: np.ndarray, distinct: np.ndarray, capitals: np.ndarray, points: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Bit k is set if the document fails the k-th of the filters A to D."""
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text, read from the array's buffers."""
    n, wide = len(texts), pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    out = [np.zeros(n, np.int64) for _ in range(5)]
    if not n:
        return out
    _, offsets, buffer = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        if ends[at + 1] - ends[at] > PIECE:
            found, to = [[x] for x in _scan_long(data[ends[at] : ends[at + 1]])], at + 1
        else:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
            found = _scan(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        for o, f in zip(out, found, strict=True):
            o[at:to] = f
        at = to
    return out


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, sha, mask) of every whole text; bit k of mask: it fails filter A, B, C or D."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lots(it):
            found = pa.array(masks(*text_counts(b.column("text"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "part", "sha")), found], ["doc_id", "part", "sha", "mask"])

    text = common.text_of("text")
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, sha binary, mask int")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic: whether a label of the row's id says so. Rows without an id have none and aren't joined."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    said = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    no = F.lit(False)
    found = rows.filter("doc_id is not null").join(common.small(said), "doc_id", "left").select(*rows.columns, F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return found.unionByName(rows.filter("doc_id is null").select(*rows.columns, no.alias("good"), no.alias("toxic")))


def cells(rows: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n) of rows (doc_id, part, sha, mask, good, toxic); bit 4 of mask: a smaller id has the text."""
    keys = ["sha", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    none = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    groups = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), least.alias("w"), none.alias("free"))
    first = F.min("w.doc_id").over(Window.partitionBy("sha"))
    alone = F.col("free") + F.when(F.col("w.doc_id") == first, F.col("w.n")).otherwise(0)
    split = groups.select("part", "mask", "good", "toxic", "n", alone.alias("alone"))
    both = F.array(F.struct("mask", F.col("alone").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))
    flat = split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    return flat.filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """The orders, and for each order and step the filter's bit and the bits of the filters before it."""
    names = ["".join(p) for p in permutations(FILTERS)]
    bit = np.array([[1 << FILTERS.index(c) for c in p] for p in names])
    return names, bit, np.cumsum(bit, axis=1) - bit


def audit(found: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts ...): :func:`cells` applied to every order of the filters."""
    width = 1 << len(FILTERS)
    count = lambda k, c: F.coalesce(F.sum(F.when((F.col("mask") == k) & c, F.col("n"))), F.lit(0))
    wide = lambda c: F.array(*[count(k, c) for k in range(width)])
    by_part = found.groupBy("part").agg(wide(F.lit(True)).alias("n"), wide(F.col("good")).alias("good"), wide(F.col("toxic")).alias("toxic"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bit, before = _orders()
        mask = np.arange(width)
        fails, late = (mask & bit[..., None]) > 0, (mask & before[..., None]) > 0
        kept, removed, redundant = (mask & (bit | before)[..., None]) == 0, fails & ~late, fails & late
        only = mask == bit[..., None]
        for b in it:
            for k in range(b.num_rows):
                n, good, toxic = (np.asarray(b.column(c)[k].values) for c in ("n", "good", "toxic"))
                gone = removed @ n
                whole = {f: int(gone[bit == f].sum()) for f in np.unique(bit)}
                rows = [kept @ n, gone, redundant @ n, only @ n, removed @ good, removed @ toxic, np.vectorize(whole.get)(bit)]
                left = [pa.array([b.column("part")[k].as_py()] * bit.size, pa.string()), pa.array(np.repeat(names, bit.shape[1])), pa.array(np.tile(np.arange(1, bit.shape[1] + 1), len(names)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*left, *[pa.array(r.ravel(), pa.int64()) for r in rows]], ["part", "filter_order", "step", *counts])

    return by_part.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in counts)}")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents (doc_id, source, text) with labels (doc_id, quality, toxic)."""
    return audit(cells(labelled(document_masks(docs), labels)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return filter_audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL13 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) b(l, bit)),
p AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM b a, b b, b c, b d, b e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM p, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
