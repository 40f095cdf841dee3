"""DuckDB SQL for queries whose rows come step by step: spanning forests, base graphs, slopes of an altitude profile, change points."""

from __future__ import annotations


def forest(pairs: str = "pairs") -> str:
    """CTEs ending in ``forest (grp, a, b, w)``, the maximum spanning forests of ``pairs (grp, a, b, w)``: edges are folded heaviest first into a list of the nodes' labels."""
    return f"""nodes AS (SELECT grp, list_sort(list_distinct(list_concat(list(a), list(b)))) AS ns FROM {pairs} GROUP BY grp),
ranked AS (SELECT grp, list({{'i': list_position(ns, a)::INT, 'j': list_position(ns, b)::INT, 'a': a, 'b': b, 'w': w, 'l': NULL::INT[], 'f': NULL::STRUCT(a BIGINT, b BIGINT, w DOUBLE)[]}} ORDER BY w DESC, a, b) AS es, any_value(ns) AS ns FROM {pairs} JOIN nodes USING (grp) GROUP BY grp),
folded AS (SELECT grp, list_reduce(list_prepend({{'i': 0, 'j': 0, 'a': 0::BIGINT, 'b': 0::BIGINT, 'w': 0e0, 'l': range(1, len(ns) + 1)::INT[], 'f': []::STRUCT(a BIGINT, b BIGINT, w DOUBLE)[]}}, es),
  lambda s, e: {{'i': 0, 'j': 0, 'a': 0::BIGINT, 'b': 0::BIGINT, 'w': 0e0,
    'l': CASE WHEN s.l[e.i] <> s.l[e.j] THEN list_transform(s.l, lambda x: CASE WHEN x = s.l[e.j] THEN s.l[e.i] ELSE x END) ELSE s.l END,
    'f': CASE WHEN s.l[e.i] <> s.l[e.j] THEN list_append(s.f, {{'a': e.a, 'b': e.b, 'w': e.w}}) ELSE s.f END}}).f AS f FROM ranked),
forest AS (SELECT grp, u.a AS a, u.b AS b, u.w AS w FROM (SELECT grp, unnest(f) AS u FROM folded))"""


def base_graphs(sims: str, share: float = 0.75, steps: int = 10) -> str:
    """CTEs ending in ``based (grp, graph, threshold, a, b)`` of ``sims (grp, a, b, similarity)``."""
    climb, steps_sql = "t0", []
    for k in range(steps):
        climb = f"c{k}"
        before = f"c{k - 1}" if k else "t0"
        steps_sql.append(f"{before} + (1e0 - {before}) * {share * k / max(steps - 1, 1)!r}::DOUBLE AS {climb}")
    thresholds = "thr0 AS (SELECT grp, t0 FROM low)"
    for k, s in enumerate(steps_sql):
        thresholds += f", thr{k + 1} AS (SELECT *, {s} FROM thr{k})"
    listed = ", ".join(f"{{'step': {k}, 'threshold': c{k}}}" for k in range(steps))
    return f"""linked AS (SELECT grp, a, b, similarity AS w FROM {sims} WHERE similarity > 0), {forest("linked")},
sizes AS (SELECT grp, count(*) AS n FROM (SELECT grp, a AS node FROM {sims} UNION SELECT grp, b FROM {sims}) GROUP BY grp),
trees AS (SELECT grp, count(*) AS edges, min(w) AS least FROM forest GROUP BY grp),
weak AS (SELECT grp, n, CASE WHEN edges = n - 1 THEN least ELSE 0e0 END AS weakest FROM sizes LEFT JOIN trees USING (grp)),
low AS (SELECT grp, coalesce(max(w) FILTER (w < weakest), CASE WHEN count(w) < n * (n - 1) / 2 AND weakest > 0 THEN 0e0 END, 1e0) AS t0 FROM weak LEFT JOIN linked USING (grp) GROUP BY grp, n, weakest),
{thresholds}, over AS (SELECT grp, u.step AS step, u.threshold AS threshold FROM (SELECT grp, unnest([{listed}]) AS u FROM thr{steps})),
hits AS (SELECT grp, step, threshold, a, b FROM {sims} JOIN over USING (grp) WHERE threshold < similarity),
firsts AS (SELECT grp, min(step) AS step FROM (SELECT grp, step, count(*) AS n FROM hits GROUP BY grp, step) GROUP BY grp, n),
based AS (SELECT grp, graph, threshold, a, b FROM hits JOIN (SELECT grp, step, CAST(row_number() OVER (PARTITION BY grp ORDER BY step) - 1 AS INT) AS graph FROM firsts) USING (grp, step))"""


def slopes(points: str, window: int = 10, up: float = 10.0, down: float = -10.0, transition: float = 1200.0, margin: float = 500.0) -> str:
    """CTEs ending in ``tola (id, kind, time, lat, lon)`` of ``points``, taken as one sample a second; the last sample is left out."""
    return f"""prof AS (SELECT *, x + 1e0 AS sec FROM (SELECT id, alt, lat, lon, row_number() OVER (PARTITION BY id ORDER BY t, event_id) - 1 AS x, count(*) OVER (PARTITION BY id) AS n FROM {points}) WHERE x < n - 1 AND n > 2),
climb AS (SELECT id, min(x) FILTER (alt > {transition}) AS hi FROM prof GROUP BY id),
descent AS (SELECT id, hi, min(x) FILTER (x >= coalesce(hi, 0) AND alt < {transition}) AS low FROM prof JOIN climb USING (id) GROUP BY id, hi),
fits AS (SELECT id, hi, low, max(alt) FILTER (x = hi) AS height,
  count(*) FILTER (x >= hi - {window} AND x < hi) AS up_n, regr_slope(alt, sec) FILTER (x >= hi - {window} AND x < hi) AS up_slope, min(x) FILTER (x < hi AND alt > 0) AS up_x,
  count(*) FILTER (x >= low AND x < low + {window}) AS down_n, regr_slope(alt, sec) FILTER (x >= low AND x < low + {window}) AS down_slope, max(x) FILTER (x >= low AND alt > 0) AS down_x
  FROM prof JOIN descent USING (id) GROUP BY id, hi, low),
marks AS (SELECT id, 'takeoff' AS kind, up_x AS x FROM fits WHERE up_n >= 2 AND height <= {transition + margin} AND up_slope >= {up}
  UNION ALL SELECT id, 'landing', down_x FROM fits WHERE down_n >= 2 AND down_slope < {down}),
tola AS (SELECT CAST(id AS VARCHAR) AS id, kind, sec AS time, lat, lon FROM marks JOIN prof USING (id, x))"""


def _optimal(name: str, points: str, col: str, variance: float) -> str:
    """CTEs ending in ``name (id, marks)``: where the cheapest cut of a flight's values begins its stretches, from 0; a stretch costs its squared deviation over the variance, a change ln(n)."""
    zero = "{'b': [-ln(n)], 'p': []::INT[], 's': [0e0], 'q': [0e0], 'x': 0e0}"
    cost = "s.b[j] + (s.q[-1] + e.x * e.x - s.q[j] - pow(s.s[-1] + e.x - s.s[j], 2) / (len(s.b) + 1 - j)) / {v}e0"
    costs = f"list_transform(range(1, len(s.b) + 1), lambda j: {cost.format(v=variance)})"
    return f"""{name}_v AS (SELECT id, count(*) AS n, list({{'b': NULL::DOUBLE[], 'p': NULL::INT[], 's': NULL::DOUBLE[], 'q': NULL::DOUBLE[], 'x': {col}}} ORDER BY k) AS xs FROM {points} GROUP BY id),
{name}_f AS (SELECT id, n, list_reduce(list_prepend({zero}, xs), lambda s, e: {{
    'b': list_append(s.b, list_min({costs}) + ln(n)), 'p': list_append(s.p, CAST(list_position({costs}, list_min({costs})) - 1 AS INT)),
    's': list_append(s.s, s.s[-1] + e.x), 'q': list_append(s.q, s.q[-1] + e.x * e.x), 'x': 0e0}}).p AS p FROM {name}_v),
{name}_b AS (SELECT id, p, p[n] AS c FROM {name}_f UNION ALL SELECT id, p, p[c] FROM {name}_b WHERE c > 0),
{name} AS (SELECT id, list(c ORDER BY c) AS marks FROM {name}_b GROUP BY id)"""


def _merged(rows: str, gap: float) -> str:
    """A list of rows, each of which goes into its predecessor as their mean while it is less than ``gap`` later."""
    mean = "{" + ", ".join(f"'{c}': (s[-1].{c} + e[1].{c}) / 2" for c in ("time", "lat", "lon", "alt", "vel")) + "}"
    return f"list_reduce(list_transform({rows}, lambda r: [r]), lambda s, e: CASE WHEN e[1].time - s[-1].time < {gap} THEN list_append(s[1:len(s) - 1], {mean}) ELSE list_concat(s, e) END)"


def change_points(points: str, limit: float = 500.0) -> str:
    """CTEs (recursive) ending in ``points_of (id, k, kind, time, lat, lon, alt, vel)`` of ``points (id, k from 1, time, lat, lon, alt, vel, hdg)``."""
    return f"""track AS (SELECT id, count(*) AS n, list({{'time': time, 'lat': lat, 'lon': lon, 'alt': alt, 'vel': vel}} ORDER BY k) AS rows FROM {points} GROUP BY id),
edge AS (SELECT id, coalesce(min(k) FILTER (above AND NOT was) - 1, -1) AS up, coalesce(min(k) FILTER (NOT above AND was) - 1, -1) AS down FROM (
  SELECT id, k, above, lag(above) OVER (PARTITION BY id ORDER BY k) AS was FROM (SELECT id, k, alt > {limit} AS above FROM {points})) GROUP BY id),
{_optimal("turned", points, "hdg", 1)}, {_optimal("risen", points, "alt", 1000)},
ended AS (SELECT id, n, rows, up, down, CASE WHEN down >= 0 THEN list_append(list_filter(marks, lambda m: m <= down), down) ELSE list_append(marks, n - 1) END AS marks FROM track JOIN edge USING (id) JOIN turned USING (id)),
begun AS (SELECT *, CASE WHEN up >= 0 THEN list_prepend(up, list_filter(marks, lambda m: m >= up)) ELSE marks END AS own FROM ended),
turns AS (SELECT id, rows, up, down, {_merged("list_transform(list_append(list_prepend(0, own), n - 1), lambda m: rows[m + 1])", 60)} AS out FROM begun),
tops AS (SELECT id, rows, down, CASE WHEN up >= 0 AND out[1].time > rows[up + 1].time THEN list_prepend(rows[up + 1], out) ELSE out END AS out FROM turns),
whole AS (SELECT id, 'turn' AS kind, CASE WHEN down >= 0 AND out[-1].time < rows[down + 1].time THEN list_append(out, rows[down + 1]) ELSE out END AS out FROM tops
  UNION ALL SELECT id, 'rise', {_merged("list_transform(list_append(list_prepend(0, marks), n - 1), lambda m: rows[m + 1])", 120)} FROM track JOIN risen USING (id)),
points_of AS (SELECT id, kind, CAST(k - 1 AS INT) AS k, out[k].time AS time, out[k].lat AS lat, out[k].lon AS lon, out[k].alt AS alt, out[k].vel AS vel FROM (SELECT *, unnest(range(1, len(out) + 1)) AS k FROM whole))"""
