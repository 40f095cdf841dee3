"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Targets are given shares of a dimension's values; where none are given
they are tempered shares: a group's share of tokens to a power below 1, normalised, which lifts small groups. Raking multiplies
each dimension's factors in turn until the weighted tokens meet all marginals. A cell's factor times one rate, chosen so that
the expected tokens are a budgeted share, is the probability with which its documents stay; the draw depends on the
document's id only. A cell that would need more than all of its documents keeps them all and carries the
excess as weight, so that weighted tokens still meet the marginals.

The factors of the sources follow from those of languages and topics, so a sweep is one pass over a table with a row for each
source, however many there are; what the driver holds and sends is a number for each (language, topic). The result
tells how far the marginals were from their targets at the end (``off``) and after how many sweeps: targets that no
factors can meet, as where cells are missing, end after ``SWEEPS`` with an ``off`` above ``TOLERANCE``.

Tokens are those of the packer's vocabulary. The tables name no topics; unless a column is given, a text's form stands
for its topic.

Nulls: a null source, language or topic is a value of its own; a null or empty text has 0 tokens. Documents of cells
without tokens have the factors of their groups, 1 where a group has no tokens. Repeated rows draw alike; a null id is drawn
like one of its own. An empty table gives an empty result. Extra columns of any name aren't read, and the stage returns
them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_ids

DIMENSIONS = ("source", "lang", "topic")
#: Powers of the token shares that make the targets.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: The expected share of tokens that stays, at most.
BUDGET = 0.8
SWEEPS, TOLERANCE = 200, 1e-9
#: Rates tried at once, and how often the best bracket is divided again.
RATES, RATE_ROUNDS = 256, 4
TOKENIZER = "word_bpe_49k.json"

_OF = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(np.int64)
_TABLE, _DIGITS, _LINES = _OF(b"|\t#$%&*"), _OF(b"0123456789"), _OF(b"\n")


def form(text: str) -> str:
    """What a text's form says of its topic: tables, figures, lists, notes or prose."""
    n = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    if counts @ _TABLE > 0.03 * n:
        return "table"
    if counts @ _DIGITS > 0.03 * n:
        return "figures"
    if counts @ _LINES > 0.012 * n:
        return "list"
    return "note" if n < 400 else "prose"


def counted(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc_id, th, source, lang, topic, n_tokens); th: the row's key."""
    given = topic is not None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids.held(TOKENIZER)
        for b in common.lots(it):
            n, topics = [], []
            for t in b.column("text"):
                t = t.as_py()
                n.append(len(words.ids(t)) // 2)
                if not given:
                    topics.append(form(t))
            topics = b.column("topic") if given else pa.array(topics, pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "th", "source", "lang")), topics, pa.array(n, pa.int64())], ["doc_id", "th", *DIMENSIONS, "n_tokens"])

    text = common.text_of("text")
    named = F.lit(None).cast("string") if topic is None else topic.cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key(docs).alias("th"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), named.alias("topic"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, source string, lang string, topic string, n_tokens long")


def goals(cells: DataFrame, dim: str, shares: dict | None = None) -> DataFrame:
    """(dim, goal): the share of the tokens that each value is to have. Values that ``shares`` doesn't name divide what it leaves by their tempered shares."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    base = F.when(F.col("t") > 0, F.pow("t", F.lit(TEMPER[dim]))).otherwise(0.0)
    spark = cells.sparkSession
    given = spark.createDataFrame(list((shares or {}).items()), "v string, share double")
    sums = sums.join(common.small(given), F.col(dim).eqNullSafe(F.col("v")), "left").select(dim, F.when(F.col("share").isNull(), base).otherwise(0.0).alias("base"), "share")
    sums = common.store(sums, "goals")
    whole, named = sums.agg(F.sum("base"), F.sum("share")).first()
    rest = max(0.0, 1.0 - (named or 0.0)) if whole else 0.0
    total = rest + (named or 0.0)
    return sums.select(dim, ((F.coalesce("share", F.col("base") * (rest / whole if whole else 0.0))) / (total or 1.0)).alias("goal"))


def _summed(by_source: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray, float, np.ndarray], None]) -> np.ndarray:
    """A vector of ``size`` that ``part(k, x, goal, out)`` adds up over the sources' rows; a task sends one vector."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in it:
            for ks, xs, goal in zip(b.column("ks"), b.column("xs"), b.column("goal").to_pylist(), strict=True):
                part(np.asarray(ks.values), np.asarray(xs.values), goal, out)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at], pa.float64())], ["at", "x"])

    rows = by_source.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[rows["at"].to_numpy(np.int64)] = rows["x"].to_numpy(float)
    return out


def _source_factor(xs: np.ndarray, gs: np.ndarray, goal: float) -> float:
    now = float(xs @ gs)
    return goal / now if now > 0 else 1.0


def rake(by_source: DataFrame, groups: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, float, int]:
    """(factor of each (language, topic), worst distance of a marginal from its target, sweeps).

    by_source: (ks, xs, goal), a source's token shares by (language, topic) and its target share. groups: for each other dimension the value's number of each
    (language, topic) and the target shares by value.
    """
    g = before = np.ones(size)
    worst, sweep = np.inf, 0
    while worst > TOLERANCE and sweep < SWEEPS:
        sweep += 1

        # sums of the sources' factors times their shares, and the source marginals' distance under the factors so far
        def part(ks: np.ndarray, xs: np.ndarray, goal: float, out: np.ndarray, g: np.ndarray = g, before: np.ndarray = before) -> None:
            out[ks] += _source_factor(xs, g[ks], goal) * xs
            out[size] += abs(_source_factor(xs, before[ks], goal) * float(xs @ g[ks]) - goal)

        y = _summed(by_source, size + 1, part)
        worst, y = (y[size] if sweep > 1 else np.inf), y[:size]
        before, g, off = g, g.copy(), 0.0
        for codes, goal in groups:
            now = np.bincount(codes, y * g, len(goal))
            off = max(off, float(np.abs(now - goal).max(initial=0)))
            g *= np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[codes]
        worst = max(worst, off)
        if not size:
            return g, 0.0, sweep
    return before, worst, sweep


def _rate(by_source: DataFrame, g: np.ndarray, budget: float) -> float:
    """The rate at which the expected share of tokens, each cell whole at most, is the budget."""
    low, high = 0.0, None
    for _ in range(RATE_ROUNDS):
        tried = np.geomspace(1e-9, 1e9, RATES) if high is None else np.linspace(low, high, RATES)

        def part(ks: np.ndarray, xs: np.ndarray, goal: float, out: np.ndarray, tried: np.ndarray = tried) -> None:
            f = _source_factor(xs, g[ks], goal) * g[ks]
            for x, y in zip(xs, f, strict=True):
                out += x * np.minimum(1.0, tried * y)

        got = _summed(by_source, RATES, part)
        at = int(np.searchsorted(got >= budget, True))
        if at == RATES:
            return float(tried[-1])
        low, high = (float(tried[at - 1]) if at else low), float(tried[at])
    return high


def fitted(cells: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> tuple[DataFrame, float, int]:
    """((source, lang, topic, factor) of the cells (source, lang, topic, tokens), off, sweeps); factors hold the rate."""
    targets = targets or {}
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    pairs = sorted((tuple(r) for r in cells.select("lang", "topic").distinct().collect()), key=lambda p: [(x is not None, x or "") for x in p])
    groups = []
    for at, dim in ((0, "lang"), (1, "topic")):
        goal = {r[0]: r[1] for r in goals(cells, dim, targets.get(dim)).collect()}
        number = {v: i for i, v in enumerate(goal)}
        groups.append((np.array([number[p[at]] for p in pairs], np.int64), np.array(list(goal.values()), float)))
    named = spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "l string, t string, k long")
    coded = cells.join(F.broadcast(named), F.col("lang").eqNullSafe(F.col("l")) & F.col("topic").eqNullSafe(F.col("t"))).select("source", "k", (F.col("tokens") / total).alias("x"))
    lists = coded.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("c"))
    wanted = goals(cells, "source", targets.get("source")).withColumnRenamed("source", "s")
    by_source = common.store(lists.join(wanted, F.col("source").eqNullSafe(F.col("s"))).select("source", F.col("c.k").alias("ks"), F.col("c.x").alias("xs"), "goal"), "by-source")
    g, off, sweeps = rake(by_source, groups, len(pairs))
    rate = _rate(by_source, g, budget)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for source, ks, xs, goal in zip(b.column("source").to_pylist(), b.column("ks"), b.column("xs"), b.column("goal").to_pylist(), strict=True):
                k, x = np.asarray(ks.values), np.asarray(xs.values)
                f = _source_factor(x, g[k], goal) * g[k] * rate
                langs, topics = [pairs[i][0] for i in k], [pairs[i][1] for i in k]
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(k), pa.string()), pa.array(langs, pa.string()), pa.array(topics, pa.string()), pa.array(f, pa.float64())], [*DIMENSIONS, "factor"])

    return common.store(by_source.mapInArrow(run, "source string, lang string, topic string, factor double"), "mix-fitted"), off, sweeps


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, topic: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, source, lang, text) as doc_id, th, source, lang, topic, n_tokens, prob, weight, kept, off, sweeps.

    targets: the share of tokens that values of ``source``, ``lang`` or ``topic`` are to have, as {"lang": {"en": 0.5}}; tempered shares for the others.
    """
    rows = common.store(counted(docs, topic), "mix-rows")
    cells = common.store(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    found, off, sweeps = fitted(cells, targets, budget)
    own = found.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "factor", F.least(F.lit(1.0), "factor").alias("prob"))
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
    out = rows.join(common.small(own), same[0] & same[1] & same[2])
    weight = F.when(F.col("prob") > 0, F.col("factor") / F.col("prob")).otherwise(0.0)
    kept = common.uniform("doc_id", F.lit("mix")) < F.col("prob")
    return out.select("doc_id", "th", *DIMENSIONS, "n_tokens", "prob", weight.alias("weight"), kept.alias("kept"), F.lit(off).alias("off"), F.lit(sweeps).alias("sweeps"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return mix(common.documents(spark, sf_dir).select("doc_id", "source", "lang", "text")).drop("th")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents. A draw depends on the id alone, so rows with one id and cell stay or go together."""
    common.small_batches(spark)
    return common.kept_rows(docs, mix(docs).select("doc_id", "th", "kept"))
