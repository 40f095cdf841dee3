"""Graphs: components, quality of communities, routes of legs along an airway graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import geo
from ..sources.tables import drop, written
from . import kernels
from .flows import whole_tiles
from .trajectory import checked_broadcast

#: A leg follows an edge if its fitness is over this.
LEAST_FITNESS = 0.3


#: Edges that a task gathers before it thins them out.
THIN_ROWS = 500_000


def gathered(it: Iterator[pa.RecordBatch], thin: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """The batches, thinned out each time that enough have come together; what stays is sent on once it is many rows itself, so a task holds a few million at most."""
    held: list = []
    fresh = 0
    for b in it:
        held.append(pa.Table.from_batches([b]))
        fresh += b.num_rows
        if fresh >= THIN_ROWS:
            now, fresh = thin(pa.concat_tables(held)), 0
            held = [now]
            if now.num_rows > 2 * THIN_ROWS:
                yield from now.to_batches(max_chunksize=10_000)
                held = []
    if held:
        yield from thin(pa.concat_tables(held)).to_batches(max_chunksize=10_000)


#: The name of before, under which it is called as well.
_gathered = gathered


def _long_ends(edges: DataFrame) -> bool:
    return all(isinstance(edges.schema[c].dataType, IntegralType) for c in ("a", "b"))


def star_rows(t: pa.Table) -> pa.Table:
    """Edges (a, b) of whole numbers with the same connected parts: a node's to the smallest node that the table's edges reach."""
    node, label = kernels.stars(t.column("a").to_numpy(), t.column("b").to_numpy())
    return pa.table({"a": node, "b": label})


def joining_rows(t: pa.Table) -> pa.Table:
    """Rows (a, b, ...) whose edges (a, b) connect what all of the table connect; no two of them are in a ring."""
    ends = [np.asarray(t.column(c).to_numpy()) for c in ("a", "b")]
    return t.take(kernels.forest_rows(*ends, np.zeros(t.num_rows)))


def forest_rows(t: pa.Table) -> pa.Table:
    """Rows of the maximum spanning forest of edges (a, b), heavy by their last column."""
    return t.take(kernels.forest_rows(*(np.asarray(t.column(c).to_numpy()) for c in ("a", "b", t.column_names[-1]))))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same connected parts: of a task's edges each node keeps one, to the smallest node that these reach. Ends that aren't whole numbers stay as they are."""
    if not _long_ends(edges):
        return edges.select("a", "b")

    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    whole = ends.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).filter("a is not null")
    thinned = whole.mapInArrow(lambda it: gathered(it, star_rows), "a long, b long")
    return thinned.select(*[F.col(c).cast(edges.schema[c].dataType).alias(c) for c in ("a", "b")])


def thinned_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b, w), a < b, with the same maximum spanning forest: a task's edges that aren't in the forest of its own edges aren't in that of all."""
    if not _long_ends(edges):
        return edges.select("a", "b", "w")

    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"))
    thinned = ends.mapInArrow(lambda it: gathered(it, forest_rows), "a long, b long, w double")
    return thinned.select(*[F.col(c).cast(edges.schema[c].dataType).alias(c) for c in ("a", "b")], "w")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (a, b): the smallest node that is reachable.

    Each task first replaces its edges by one for each of their nodes (``contracted``), so what is written and shuffled grows with the nodes, not with
    the edges. Labels then fall along the edges and along themselves (pointer jumping), so the rounds grow with the
    logarithm of the distance; every round is written in the shared folder.
    """
    edges = contracted(edges)
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), F.col("label").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = now.join(seen, now["node"] == seen["a"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"))
        step = written(step, "labels")
        # where a node's label has a label of its own, follow it; each label is looked up once, and sent along while labels are few
        jump = step.select("label").distinct().join(step.select(F.col("node").alias("label"), F.col("label").alias("j")), "label")
        nxt = written(step.join(checked_broadcast(jump), "label", "left").select("node", F.least("label", F.coalesce("j", "label")).alias("label")), "labels")
        total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        same = total(nxt) == total(now)
        drop(now, step)
        now = nxt
        if same:
            drop(both)
            return now


def cpm_quality(edges: DataFrame, homes: DataFrame, gamma: float = 0.7) -> DataFrame:
    """(community, quality): inner weight less gamma for each pair of members.

    Edges (u, v, w) are looked up in homes (node, community); edges (community, w) are inside one already and meet no node.
    """
    if "community" not in edges.columns:
        u, v = homes.select(F.col("node").alias("u"), F.col("community").alias("cu")), homes.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        edges = edges.join(u, "u").join(v, "v").filter("cu = cv").withColumn("community", F.col("cu"))
    inner = edges.groupBy("community").agg(F.sum("w").alias("w"))
    size = homes.groupBy("community").agg(F.count("*").alias("n"))
    return size.join(inner, "community", "left").select("community", (F.coalesce("w", F.lit(0.0)) - gamma * F.col("n") * (F.col("n") - 1) / 2.0).alias("quality"))


def scored_edges(legs: DataFrame, edges: DataFrame, margin: float = 0.5, least: float = LEAST_FITNESS, cell: float = 5.0) -> DataFrame:
    """(flight, k, leg_id, edge_id, a, b, first, rest) of legs (flight, k, ...) and the edges (edge_id, a, b, efrom_/eto_) whose ends both lie in the flight's box.

    A flight looks in the cells that its box with its margin touches, an edge stands in the cell of its start, so
    the crop is an equi join and finds each edge once. Courses and lengths are worked out once a leg and once an edge; edges
    are broadcast while their number allows, so the products of legs and edges are never shuffled.
    """
    ends = lambda c: (F.least(f"from_{c}", f"to_{c}"), F.greatest(f"from_{c}", f"to_{c}"))
    box = legs.groupBy("flight").agg(*[f(x).alias(f"_{c}_{n}") for c in ("lat", "lon") for n, f, x in (("lo", F.min, ends(c)[0]), ("hi", F.max, ends(c)[1]))])
    span = lambda c: F.sequence(F.floor((F.col(f"_{c}_lo") - margin) / cell), F.floor((F.col(f"_{c}_hi") + margin) / cell))
    boxed = geo.leg_features(legs.select("flight", "k", "leg_id", "from_lat", "from_lon", "to_lat", "to_lon")).join(box, "flight")
    cells = boxed.select("*", F.explode(span("lon")).alias("cx"), span("lat").alias("_ys")).select("*", F.explode("_ys").alias("cy")).drop("_ys")
    at = lambda c: F.floor(F.col(f"efrom_{c}") / cell)
    placed = geo.edge_features(edges).withColumns({"cx": at("lon"), "cy": at("lat")})
    near = cells.join(checked_broadcast(placed), ["cx", "cy"])
    for e in ("efrom", "eto"):
        for c in ("lat", "lon"):
            near = near.filter(F.col(f"{e}_{c}").between(F.col(f"_{c}_lo") - margin, F.col(f"_{c}_hi") + margin))
    fit = F.when(F.col("k") == 0, F.col("first")).otherwise(F.col("rest"))
    return geo.with_fitness(near).filter(fit > least).select("flight", "k", "leg_id", "edge_id", "a", "b", "first", "rest")


def greedy_routes(scored: DataFrame, n_legs: DataFrame, most: int = 5) -> DataFrame:
    """(flight, rank, edges, fitness): the first routes of connected edges, a leg each, that a depth-first search finds in greedy order. A flight is one task's.

    Flights come one after the other in a task's batches, as the window that numbers their rows leaves them, so neither a job's plan nor Python sets up anything for a single flight.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_tiles(it, ["flight"]):
            rows = list(zip(*(t.column(c).to_numpy().tolist() for c in ("k", "edge_id", "a", "b", "s")), strict=True))
            n, ends_at = t.column("n").to_numpy()[first].tolist(), [*first[1:].tolist(), t.num_rows]
            out: list[tuple[int, int, list[int], float]] = []
            for at, begin, end, legs in zip(range(len(n)), first.tolist(), ends_at, n, strict=True):
                ends: dict[int, tuple[int, int]] = {}
                by: list[dict[int, float]] = [{} for _ in range(legs)]
                for k, e, a, b, s in rows[begin:end]:
                    ends[e] = (a, b)
                    by[k][e] = s
                if all(by):
                    out += [(at, i + 1, e, s) for i, (e, s) in enumerate(kernels.route_search(by[1:], by[0], ends, most, LEAST_FITNESS))]
            if out:
                at, rank, edges, fitness = zip(*out, strict=True)
                flights = t.column("flight").take(pa.array(first[list(at)])).combine_chunks()
                yield from pa.table([flights, pa.array(rank, pa.int32()), pa.array(edges, pa.list_(pa.int64())), pa.array(fitness, pa.float64())], names=["flight", "rank", "edges", "fitness"]).to_batches(max_chunksize=10_000)

    fit = F.when(F.col("k") == 0, F.col("first")).otherwise(F.col("rest"))
    turn = F.row_number().over(Window.partitionBy("flight").orderBy("k", "edge_id"))
    rows = scored.join(n_legs, "flight").select("flight", "n", "k", "edge_id", "a", "b", fit.alias("s"), turn.alias("turn"))
    return rows.mapInArrow(run, f"flight {scored.schema['flight'].dataType.simpleString()}, rank int, edges array<long>, fitness double")


def best_routes(scored: DataFrame, n_legs: DataFrame, most: int = 5, least: float = LEAST_FITNESS) -> DataFrame:
    """(flight, rank, edges, fitness): the ``most`` routes of connected edges with the highest totals, a leg each; of equal ones the smaller edges.

    Leg by leg, for all flights at once: the best partial routes of each last edge meet the edges that start where it ends, and
    itself. ``most`` of each new last edge go on, which loses none of the best. Rounds are the legs of the longest
    flight; a round's joins are on flight and node, so neither a flight nor a node gathers in a task beyond its own candidates.
    """
    fit = F.when(F.col("k") == 0, F.col("first")).otherwise(F.col("rest"))
    edges = scored.join(n_legs, "flight").select("flight", "n", "k", "edge_id", "a", "b", fit.alias("s")).filter(F.col("s") > least)
    edges = written(edges.dropDuplicates(["flight", "k", "edge_id"]), "route-edges")
    last = edges.agg(F.max("n")).first()[0] or 0
    held = edges.filter("k = 0").select("flight", "n", F.col("edge_id").alias("e"), F.col("b").alias("at"), F.col("s").alias("total"), F.array("edge_id").alias("route"))
    done = []
    for k in range(1, last + 1):
        held = written(held, "routes")
        done.append(held.filter(F.col("n") == k).select("flight", "total", "route"))
        if k == last:
            break
        here = edges.filter(F.col("k") == k).select("flight", "edge_id", "a", "b", "s")
        open_ = held.filter(F.col("n") > k)
        on = open_.withColumn("a", F.col("at")).join(here, ["flight", "a"]).filter("edge_id <> e")
        stay = open_.join(here.withColumnRenamed("edge_id", "e"), ["flight", "e"]).withColumn("edge_id", F.col("e"))
        both = on.unionByName(stay.select(on.columns)).select("flight", "n", F.col("edge_id").alias("e"), F.col("b").alias("at"), (F.col("total") + F.col("s")).alias("total"), F.concat("route", F.array("edge_id")).alias("route"))
        held = _first_routes(both, ["flight", "e"], most)
    if not done:
        return edges.select("flight", F.lit(1).alias("rank"), F.array("edge_id").alias("edges"), F.col("s").alias("fitness")).limit(0)
    return _first_routes(reduce(DataFrame.unionByName, done), ["flight"], most, keep=True).select("flight", "rank", F.col("route").alias("edges"), F.col("total").alias("fitness"))


def _first_routes(routes: DataFrame, keys: list[str], most: int, keep: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), "route")
    out = routes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return out if keep else out.drop("rank")
