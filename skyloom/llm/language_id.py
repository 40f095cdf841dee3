"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (n = 1 to 3, in words padded by blanks).
A document's own most frequent n-grams are compared to each profile: the out-of-place distance sums how far
each n-gram's rank is from its rank in the profile, at most the profile's length. The nearest profile wins;
ties go to the language that comes first in the alphabet.

Profiles are fitted on labelled documents only, on about ``FIT_ROWS`` of them at most (a documented bound on
a hash-drawn sample); predictions read the whole text and nothing else.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Without any labelled row every document is
``und``. Null doc_ids and repeated rows are predicted like any other; an empty table gives an empty result. Extra columns of any name
aren't read; the pipeline's stage returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows that profiles are fitted on, about so many at most.
FIT_ROWS = 20_000
#: N-grams of a profile and of a document.
RANKS = 400
#: The pipeline rejects documents whose n-grams agree less than so with the nearest profile.
LEAST_SCORE = 0.2

_BITS, BLANK = np.uint64(21), np.uint64(1)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def ngrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, ascending; their counts) of a whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters[np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() > 0xFFFF:
        high = codes > 0xFFFF
        inside[high] = [chr(c).isalpha() for c in codes[high]]
    # words with one blank before, between and after; no letter has the blank's number
    c = np.full(len(codes) + 2, BLANK, np.uint64)
    c[1:-1] = np.where(inside, codes, BLANK)
    c = c[np.concatenate([[True], (c[1:] != BLANK) | (c[:-1] != BLANK)])]
    two = c[:-1] << _BITS | c[1:]
    three = (two[:-1] << _BITS | c[2:])[c[1:-1] != BLANK]
    return np.unique(np.concatenate([c[c != BLANK], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, n: int = RANKS) -> np.ndarray:
    """The n most frequent, most frequent first; ties by number."""
    if len(grams) > n:
        near = np.flatnonzero(counts >= np.partition(counts, len(counts) - n)[len(counts) - n])
        grams, counts = grams[near], counts[near]
    return grams[np.argsort(-counts, kind="stable")][:n]


def fit(rows: DataFrame, n: int = RANKS) -> dict[str, np.ndarray]:
    """Profiles of rows (text, lang): the counts of all rows, the most frequent n-grams of each language."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for b in common.lots(it):
            by: dict[str, list] = {}
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(t, letters))
            for lang, found in by.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    counts = rows.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n).toPandas()
    return {lang: x.sort_values("r")["gram"].to_numpy(np.uint64) for lang, x in sorted(top.groupby("lang"))}


class Profiles:
    """All profiles as one table of ranks by n-gram and language."""

    def __init__(self, profiles: dict[str, np.ndarray], n: int = RANKS):
        self.n, self.names = n, list(profiles)
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, p in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, p), k] = np.arange(len(p))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked n-grams to each profile."""
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = self.ranks[np.where(self.grams[at] == own, at, len(self.grams))]
        away = np.abs(ranks - np.arange(len(own))[:, None])
        return np.where(ranks < 0, self.n, np.minimum(away, self.n)).sum(axis=0)

    def predict(self, text: str, letters: np.ndarray) -> tuple[str, float]:
        grams, counts = ngrams(text, letters)
        if not len(grams) or not self.names or not (grams >> _BITS == 0).any():
            return "und", 0.0
        own = ranked(grams, counts, self.n)
        d = self.distances(own)
        best = int(np.argmin(d))
        return self.names[best], float(1 - d[best] / (self.n * len(own)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, lang_pred, score) of every whole text; th: a hash of it."""
    held = Profiles(profiles)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for b in common.lots(it):
            found = [held.predict(t.as_py(), letters) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "th", "lang_pred", "score"])

    text = common.text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, lang_pred string, score double")


def held_out() -> Column:
    """Documents that no profile may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Profiles from at most about ``fit_rows`` labelled documents that aren't held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = rows.count()
    if n > fit_rows:
        rows = rows.filter(common.uniform("doc_id", F.lit("fit")) < fit_rows / n)
    return fit(rows)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir)
    return predict(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters or unlike every language go."""
    common.small_batches(spark)
    profiles, text = Profiles(learned(docs)), docs.columns.index("text")
    # by position: mapInArrow looks columns up by names in which a dot means a field
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for b in common.lots(it):
            found = [profiles.predict(t.as_py() or "", letters) for t in b.column(text)]
            yield b.filter(pa.array([x[0] != "und" and x[1] >= LEAST_SCORE for x in found], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
