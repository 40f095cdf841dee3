"""Greedy routes of many flights: each flight's are those of the search on it alone, and no step is set up for a single flight."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import graph, kernels


def test_greedy_routes_come_from_batches_of_whole_flights(spark):
    rng, rows, n, want = np.random.default_rng(4), [], [], {}
    for f in range(60):
        legs, name = 1 + f % 4, f"f{f % 30}-{f // 30}"
        ends = {e: (int(a), int(b)) for e, (a, b) in enumerate(rng.integers(0, 4, (12, 2)))}
        # tenths tie; every seventh flight has a leg that no edge follows
        by = [{e: float(s) for e, s in enumerate(rng.integers(1, 10, 12) / 10) if s > 0.3 and not (f % 7 == 0 and k == legs // 2)} for k in range(legs)]
        rows += [(name, k, k, e, *ends[e], s if k == 0 else 9.0, 9.0 if k == 0 else s) for k in range(legs) for e, s in by[k].items()]
        n.append((name, legs))
        want[name] = kernels.route_search(by[1:], by[0], ends, 5, graph.LEAST_FITNESS) if all(by) else []
    scored = spark.createDataFrame(rows, "flight string, k int, leg_id long, edge_id long, a long, b long, first double, rest double")
    out = graph.greedy_routes(scored.repartition(3), spark.createDataFrame(n, "flight string, n int"))
    got = {}
    for r in out.orderBy("flight", "rank").collect():
        got.setdefault(r.flight, []).append((r.edges, r.fitness))
        assert r.rank == len(got[r.flight])
    assert got == {f: found for f, found in want.items() if found}
    assert out.filter(F.size("edges") == 0).count() == 0
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
