"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle windows, recursive exact joins.

Sets are a document's distinct word shingles, as 64-bit hashes. Under the symmetric difference D, a metric,
two sets of sizes a and b have Jaccard similarity t or more exactly when D <= (1-t)/(1+t) * (a+b).

Documents of a corpus lie at Jaccard distance 1 from nearly every other, so pivots drawn from the corpus would send
nearly all of them to every region. The first level therefore takes the empty set and single shingles as pivots. The
distance to the empty set is a set's size and gives the size window. A set's nearest shingles are its own, taken in
one total order; D(x, {s}) bounds what two sets that meet at s can still share: if s is the first shingle that
both hold, at places i and j (from 0), then D >= a + b - 2 * min(a - i, b - j). So a document is home in the regions of its
first (1-t)/(1+t)*a + 1 shingles (core) and is replicated, as a boundary document, to those up to (1-t)*a + 1;
two boundary documents never need to meet. The order puts rare shingles first, so that text which many documents
share makes a region only for documents that consist of it; any order gives the same links.

Inside a region the join recurses with documents as pivots, the most central first (those whose place in the region
is least for their size). Members are measured against a pivot where the windows allow a link; linked ones fall into its
component, and members of one component need no further pivot among themselves, so a group of n near copies costs n
measurements, not n*n. Distances to the region's first pivot give the next rounds their triangle windows
|D(x,p) - D(y,p)| <= (1-t)/(1+t) * (a+b). Each round takes STEP times as many pivots as the last; a region ends when it is
one component or all of its core documents were pivots, so the rounds grow with the logarithm of a region's size and no pair is
left out. Equal sets are one node from the start. Each pair is decided by the two whole sets, so no link is lost;
shingles of a pair could only be confused by equal 64-bit hashes.

A pair's sets meet in one task with its pivot: the pivot's set travels once for each million shingles of its partners,
and a hub with more partners is dealt to several tasks.

Nulls: a null or wordless text has an empty set and links with nothing. A null doc_id is a document; its
component_id is the smallest non-null id of the component, else null. Repeated rows link with each other. An empty
table gives an empty result. Extra columns of any name are not read, and the stage returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, PERCENT = 4, 85
#: What the near-duplicate stage of a pipeline asks; the constants above bind op1 alone.
STAGE_WORDS, STAGE_PERCENT = 5, 80
#: A shingle that more sets than this bring to the front counts as common; levels of commonness are LEVEL times apart. Any order gives the same links.
COMMON, LEVEL = 32, 4
#: Places of the table of common shingles for each of them, and at most; a place that two shingles share only makes one more of them common.
TABLE_ROOM, TABLE_MOST = 64, 1 << 24
#: Each round has so many times the pivots of the last.
STEP = 8
#: Shingles of the partners that one task compares with a pivot at a time.
HUB_SHINGLES = 1 << 20
MEMO_WORDS = 200_000
#: Rows that a worker takes at a time.
SLICE = 256

SKETCH = "doc_id long, th long, n long, f1 long, f2 long, pool array<long>"
#: Shingles of a pool for each that a document must bring.
POOL = 1.5


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 40:
            self[word] = h
        return h


_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, memo: dict, k: int = WORDS) -> np.ndarray:
    """The distinct k-word shingles of a text, as sorted hashes. A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = _mix(h * _P + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def prefix_size(n: np.ndarray | int, percent: int = PERCENT):
    """How many first shingles of n a document must bring: any partner shares one of them."""
    return n - (percent * n + 99) // 100 + 1


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that a worker holds few sets at once."""
    for b in it:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _sketch_batches(it: Iterator[pa.RecordBatch], k: int = WORDS, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    memo = _Words()
    for b in _slices(it):
        sizes, prints, first = [], [], []
        for t in b.column("text"):
            s = shingles(t.as_py(), memo, k)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_intdigest(s.tobytes()))
            first.append(s[: int(POOL * prefix_size(len(s), percent))].view(np.int64) if len(s) else np.zeros(0, np.int64))
        half = lambda shift: pa.array(np.array([p >> shift & (2**64 - 1) for p in prints], np.uint64).view(np.int64))  # noqa: E731, B023
        at = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32))
        lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(sizes, pa.int64()), half(64), half(0), lists], ["doc_id", "th", "n", "f1", "f2", "pool"])


def _source(docs: DataFrame) -> DataFrame:
    text = common.text_of("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key(docs).alias("th"), text.cast("binary").alias("text"))


def _sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(rep, set) of rows (rep, id0, th): whole sets as sorted little-endian hashes. Repeated rows may give a set again from another task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, done = _Words(), set()
        for b in _slices(it):
            reps, sets = [], []
            for rep, t in zip(b.column("rep").to_pylist(), b.column("text"), strict=True):
                if rep not in done:
                    done.add(rep)
                    reps.append(rep)
                    sets.append(shingles(t.as_py(), memo, k).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "set"])

    src = _source(docs).select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("id0"), "th", "text")
    return src.join(common.small(needed), ["id0", "th"]).select("rep", "text").mapInArrow(run, "rep long, set binary")


def _exploded(sets: DataFrame) -> DataFrame:
    """(s): every shingle of the sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x in b.column("set"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "<i8"))], ["s"])

    return sets.select("set").mapInArrow(run, "s long")


def _common(shingles: DataFrame) -> DataFrame:
    return shingles.groupBy("s").agg(F.count("*").alias("c")).filter(F.col("c") > COMMON)


def _levels(hot: DataFrame) -> np.ndarray:
    """How common shingles are, by their low bits: 0 is rare. Its size is bounded; shingles that share a place share its level."""
    n = hot.count()
    size = min(TABLE_MOST, 1 << max(6, (TABLE_ROOM * n).bit_length()))
    level = (1 + F.floor(F.log(F.col("c") / COMMON) / float(np.log(LEVEL)))).cast("int")
    rows = hot.groupBy(F.col("s").bitwiseAND(F.lit(size - 1)).cast("int").alias("at")).agg(F.max(level).alias("level")).toPandas()
    table = np.zeros(size, np.uint8)
    table[rows["at"].to_numpy(np.int64)] = rows["level"].to_numpy(np.uint8)
    return table


def _ordered(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted hashes in the total order: by level, then by hash."""
    return values[np.argsort(levels, kind="stable")]


def _first(nodes: DataFrame, table: np.ndarray, percent: int) -> DataFrame:
    """(rep, id0, th, n, first): a node's first shingles in the order; null where its pool holds too few of them to tell."""
    held, mask = nodes.sparkSession.sparkContext.broadcast(table), np.int64(len(table) - 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            out = []
            for n, pool in zip(b.column("n").to_pylist(), b.column("pool"), strict=True):
                v, need = np.asarray(pool.values), prefix_size(n, percent)
                lev = held.value[v & mask]
                if lev[:need].any():
                    rare = v[lev == 0]
                    v = rare if len(rare) >= need else _ordered(v, lev) if len(v) == n else None
                out.append(None if v is None else v[:need])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "id0", "th", "n")), pa.array(out, pa.list_(pa.int64()))], ["rep", "id0", "th", "n", "first"])

    return nodes.mapInArrow(run, "rep long, id0 long, th long, n long, first array<long>")


def _first_of_sets(sets: DataFrame, table: np.ndarray, percent: int) -> DataFrame:
    """(rep, n, first) from whole sets."""
    held, mask = sets.sparkSession.sparkContext.broadcast(table), np.int64(len(table) - 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            sizes, out = [], []
            for x in b.column("set"):
                v = np.frombuffer(x.as_py(), "<i8")
                sizes.append(len(v))
                out.append(_ordered(v, held.value[v & mask])[: prefix_size(len(v), percent)])
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["rep", "n", "first"])

    return sets.mapInArrow(run, "rep long, n long, first array<long>").dropDuplicates(["rep"])


def _places(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """((s, rep, n, i) of every node's first shingles, whole sets that were read for it).

    The pool of a node holds more of its lowest hashes than it must bring, so leaving out the common ones mostly
    leaves enough; only documents made of common text are read again, and what is common among them comes last as well.
    """
    need = (F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1).cast("int")
    hot = common.store(_common(nodes.select(F.explode(F.slice("pool", F.lit(1), need)).alias("s"))), "common")
    table = _levels(hot)
    sets: list[DataFrame] = []
    poor = common.store(_first(nodes, table, percent).filter("first is null").select("rep", "id0", "th"), "poor")
    if not poor.isEmpty():
        sets.append(common.store(_sets(docs, poor, k), "poor-sets"))
        hot = common.store(hot.unionByName(_common(_exploded(sets[0]))).groupBy("s").agg(F.max("c").alias("c")), "common")
        table = _levels(hot)
    first = common.store(_first(nodes, table, percent), "first")
    again = first.filter("first is null").select("rep", "id0", "th")
    fresh = common.store(again.join(poor.select("rep"), "rep", "left_anti"), "poor")
    if not fresh.isEmpty():
        sets.append(common.store(_sets(docs, fresh, k), "poor-sets"))
    out = first.filter("first is not null")
    if sets:
        held = sets[0] if len(sets) == 1 else sets[0].unionByName(sets[1])
        read = common.store(_first_of_sets(held.join(common.small(again.select("rep")), "rep", "left_semi"), table, percent), "first")
        out = out.select("rep", "n", "first").unionByName(read)
    return out.select("rep", "n", F.posexplode("first").alias("i", "s")), sets


def _may_link(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Sizes and places allow a link of sets that first meet at places i and j."""
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes & (F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent)


def _regions(places: DataFrame, percent: int) -> DataFrame:
    """Members (s, rep, n, i, core) of the regions where two documents meet, one of them at home."""
    placed = places.withColumn("core", F.col("i") * (100 + percent) <= F.col("n") * (100 - percent))
    shared = placed.groupBy("s").agg(F.count("*").alias("c"), F.max("core").alias("home")).filter("c > 1 and home").select("s")
    return placed.join(shared, "s", "left_semi")


def _measured(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, la, lb, sum, both) of pairs (a, b, p, la, lb, sum, size): how many shingles both whole sets share; p is the end that is the pivot, size the other's."""
    spokes = pairs.withColumn("x", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    parts = spokes.groupBy("p").agg(F.ceil(F.sum("size") / HUB_SHINGLES).cast("int").alias("parts"))
    spokes = spokes.join(parts, "p").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    spokes = common.store(spokes.select("p", "part", "x"), "spokes")
    hubs = held.join(common.small(spokes.select(F.col("p").alias("rep"), "part").distinct()), "rep").select(F.col("rep").alias("p"), "part", F.lit(None).cast("long").alias("x"), "set")
    ends = held.join(common.small(spokes.withColumnRenamed("x", "rep")), "rep").select("p", "part", F.col("rep").alias("x"), "set")
    stream = hubs.unionByName(ends).repartition("p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for b in _slices(it):
            out = []
            for r, (p, x) in enumerate(zip(b.column("p").to_pylist(), b.column("x").to_pylist(), strict=True)):
                own = np.frombuffer(b.column("set")[r].as_py(), "<u8")
                if x is None:
                    hub = own
                else:
                    out.append((p, x, len(np.intersect1d(hub, own, assume_unique=True))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], ["p", "x", "both"])

    found = stream.mapInArrow(run, "p long, x long, both long").select(F.least("p", "x").alias("a"), F.greatest("p", "x").alias("b"), "both").distinct()
    return pairs.select("a", "b", "la", "lb", "sum").join(found, ["a", "b"])


def _pairs(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b, p, la, lb, size, sum): pivots and members of their regions that may link and are in different components."""
    c = F.col
    p = pivots.select("s", c("rep").alias("p"), c("n").alias("pn"), c("i").alias("pi"), c("label").alias("pl"), c("d").alias("pd"))
    near = F.abs(c("d") - c("pd")) * (100 + percent) <= (c("n") + c("pn")) * (100 - percent)
    met = members.filter("not done").join(p, "s").filter((c("label") != c("pl")) & _may_link(c("n"), c("pn"), c("i"), c("pi"), percent) & F.coalesce(near, F.lit(True)))
    own = c("rep") < c("p")
    met = met.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"), "p", F.when(own, c("label")).otherwise(c("pl")).alias("la"), F.when(own, c("pl")).otherwise(c("label")).alias("lb"), c("n").alias("size"), (c("n") + c("pn")).alias("sum"))
    one = F.min(F.struct("p", "size")).alias("o")
    return met.groupBy("a", "b", "la", "lb", "sum").agg(one).select("a", "b", "la", "lb", "sum", "o.p", "o.size")


def _compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, sets: list[DataFrame], k: int) -> DataFrame:
    """:func:`_measured` of the pairs; whole sets that ``sets`` lacks are read and added to it."""
    if pairs.isEmpty():
        return pairs.select("a", "b", "la", "lb", "sum", F.lit(0).cast("long").alias("both"))
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    for s in sets:
        ends = ends.join(s.select("rep"), "rep", "left_anti")
    ends = common.small(common.store(ends, "ends"))
    sets.append(common.store(_sets(docs, common.store(nodes.select("rep", "id0", "th").join(ends, "rep", "left_semi"), "ends"), k), "sets"))
    held = sets[0]
    for s in sets[1:]:
        held = held.unionByName(s)
    return _measured(held, pairs)


def joined(docs: DataFrame, nodes: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(rep, label) of every node with a link: its component's smallest node. nodes: rep, id0, th, n, pool."""
    places, sets = _places(docs, nodes, k, percent)
    regions = common.store(_regions(places, percent), "regions")
    turn = F.struct((F.col("i") / F.col("n")).alias("c"), "rep")
    members = regions.select("s", "rep", "n", "i", "core", turn.alias("turn"), F.col("rep").alias("label"), F.lit(None).cast("long").alias("d"), F.lit(False).alias("done"))
    known, step = [], 1
    labels = nodes.sparkSession.createDataFrame([], "rep long, label long")
    while True:
        ready = F.col("core") & ~F.col("done")
        top = Window.partitionBy("s").orderBy("turn")
        pivots = common.store(members.filter(ready).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= step).drop("r"), "pivots")
        if pivots.isEmpty():
            break
        pairs = _pairs(members, pivots, percent)
        for seen in known:
            pairs = pairs.join(common.small(seen.select("a", "b")), ["a", "b"], "left_anti")
        pairs = common.store(pairs, "pairs")
        found = common.store(_compared(docs, nodes, pairs, sets, k), "measured")
        known.append(found)
        good = found.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)
        last = pivots.groupBy("s").agg(F.max("turn").alias("last"), F.min_by("rep", "turn").alias("first"))
        members = members.join(last, "s", "left").withColumn("done", F.col("done") | F.coalesce(F.col("turn") <= F.col("last"), F.lit(False)))
        if step == 1:
            ends = [F.least("rep", "first").alias("a"), F.greatest("rep", "first").alias("b")]
            away = found.select("a", "b", (F.col("sum") - 2 * F.col("both")).alias("away"))
            members = members.select("*", *ends).join(common.small(away), ["a", "b"], "left").withColumn("d", F.when(F.col("rep") == F.col("first"), F.lit(0)).otherwise(F.col("away"))).drop("a", "b", "away")
        members = members.drop("last", "first")
        if not good.isEmpty():
            # components of this round's links between the labels so far
            now = components(good.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            renamed = common.small(now.select(F.col("node").alias("label"), F.col("label").alias("now")))
            members = members.join(renamed, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
            fresh = now.withColumnRenamed("node", "rep").join(labels.select("rep"), "rep", "left_anti")
            labels = common.store(labels.join(renamed, "label", "left").select("rep", F.coalesce("now", "label").alias("label")).unionByName(fresh), "labels")
        members = common.store(members, "members")
        still = members.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(ready).alias("ready")).filter("x < y and ready").select("s")
        members = common.store(members.join(still, "s", "left_semi"), "members")
        step *= STEP
    return labels


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, and label: the component's first row, row: the row's number, th: its key.

    Documents link where their k-word shingles have a Jaccard similarity of ``percent`` hundredths or more.
    """
    sketches = _source(docs).mapInArrow(lambda it: _sketch_batches(it, k, percent), SKETCH)
    rows = common.store(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    same = ["f1", "f2", "n"]
    groups = common.store(rows.filter("n > 0").groupBy(*same).agg(F.min("row").alias("rep")), "groups")
    nodes = rows.join(groups.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), F.coalesce("doc_id", F.lit(common.NO_ID)).alias("id0"), "th", "n", "pool")
    nodes = common.store(nodes, "nodes")
    slim = common.store(rows.drop("pool"), "rows")
    common.drop(rows)
    named = groups.join(joined(docs, nodes, k, percent), "rep", "left").select(*same, F.coalesce("label", "rep").alias("label"))
    at = slim.join(named, same, "left")
    at = common.store(at.withColumn("label", F.coalesce("label", "row")), "labelled")
    least = at.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return at.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "label", "row", "th")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return jaccard_components(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays: the one with the smallest id (of repeated rows, one). All columns stay as they are."""
    common.small_batches(spark)
    found = common.store(jaccard_components(docs, k, percent), "near")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stays")
    judged = found.join(found.groupBy("label").agg(first), "label").select("doc_id", "th", (F.col("row") == F.col("stays")).alias("kept"))
    return common.kept_rows(docs, judged)


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(spark, docs, sf_dir, STAGE_WORDS, STAGE_PERCENT)


SQL1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n_shingles + b.n_shingles - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT n.doc_id, n_shingles, min(seen) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL
"""
