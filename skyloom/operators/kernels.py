"""The steps that are sequential by nature, as numpy functions on one group."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush
from math import nan

import numpy as np

try:
    from math import fma
except ImportError:  # before Python 3.13
    from fractions import Fraction

    def fma(a: float, b: float, c: float) -> float:
        """a * b + c, rounded once."""
        return float(Fraction(a) * Fraction(b) + Fraction(c))



#: Stretches that are open at once from which on a step works on arrays.
FEW = 24


def pelt_mean(x: np.ndarray, variance: float, penalty: float | None = None) -> list[int]:
    """Change points of a normal mean with known variance, by pruned exact search; the first is 0.

    The cost of a stretch is its squared deviation over the variance; a change costs ln(n).
    """
    n = len(x)
    if n == 0:
        return []
    beta = np.log(n) if penalty is None else penalty
    sums, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (np.asarray(x, float), np.square(x, dtype=float)))
    s1, s2, beta = sums.tolist(), squares.tolist(), float(beta)
    best, least = [-beta], np.full(n + 1, -beta)
    last, open_ = [0], [0]
    for t in range(1, n + 1):
        if len(open_) > FEW:
            j = np.asarray(open_)
            m = s1[t] - sums[j]
            cost = least[j] + (s2[t] - squares[j] - m * m / (t - j)) / variance
            k = int(np.argmin(cost))
            best.append(float(cost[k]) + beta)
            last.append(int(j[k]))
            open_ = np.append(j[cost <= best[t]], t)
            open_ = open_ if len(open_) > FEW else open_.tolist()
        else:
            cost = [best[j] + (s2[t] - s2[j] - (s1[t] - s1[j]) * (s1[t] - s1[j]) / (t - j)) / variance for j in open_]
            low = min(cost)
            best.append(low + beta)
            last.append(open_[cost.index(low)])
            open_ = [j for j, c in zip(open_, cost, strict=True) if c <= best[t]]
            open_.append(t)
        least[t] = best[t]
    found, t = set(), n
    while t > 0:
        t = last[t]
        found.add(t)
    return sorted(found)


def merge_close(rows: np.ndarray, gap: float) -> list[tuple]:
    """Folds a row into its predecessor as their mean while the first column's gap stays under ``gap``."""
    out: list[tuple] = []
    for r in np.asarray(rows, float).tolist():
        if out and r[0] - out[-1][0] < gap:
            out[-1] = tuple((x + y) / 2 for x, y in zip(out[-1], r, strict=True))
        else:
            out.append(tuple(r))
    return out


def airborne(alt: np.ndarray, limit: float) -> tuple[int, int]:
    """Positions of the first rise above the limit and the first fall to it, -1 if none."""
    up = alt > limit
    rises, falls = np.flatnonzero(~up[:-1] & up[1:]) + 1, np.flatnonzero(up[:-1] & ~up[1:]) + 1
    return int(rises[0]) if len(rises) else -1, int(falls[0]) if len(falls) else -1


def turning_points(rows: np.ndarray, heading: np.ndarray, limit: float, gap: float = 60.0) -> tuple[list[tuple], bool]:
    """Rows (time, lat, lon, alt, vel) at which the heading turns, with both ends, takeoff and landing; and whether it landed."""
    n = len(rows)
    up, down = airborne(rows[:, 3], limit)
    marks = pelt_mean(heading, 1.0)
    marks = [k for k in marks if k <= down] + [down] if down >= 0 else [*marks, n - 1]
    if up >= 0:
        marks = [up] + [k for k in marks if k >= up]
    out = merge_close(rows[[0, *marks, n - 1]], gap)
    if up >= 0 and out[0][0] > rows[up, 0]:
        out.insert(0, tuple(map(float, rows[up])))
    if down >= 0 and out[-1][0] < rows[down, 0]:
        out.append(tuple(map(float, rows[down])))
    return out, down >= 0


def altitude_points(rows: np.ndarray, gap: float = 120.0) -> list[tuple]:
    return merge_close(rows[[0, *pelt_mean(rows[:, 3], 1000.0), len(rows) - 1]], gap)


def _slope(t: np.ndarray, h: np.ndarray) -> float:
    """regr_slope(h, t), to the last bit as DuckDB folds the rows in order, as slopes may lie at a limit; nan altitudes don't count."""
    n, mt, mh, both, own = 0, 0.0, 0.0, 0.0, 0.0
    for x, y in zip(t.tolist(), h.tolist(), strict=True):
        if y != y:
            continue
        n += 1
        dt = x - mt
        mt += dt / n
        mh += (y - mh) / n
        both = fma(dt, y - mh, both)
        own = fma(dt, x - mt, own)
    return (both / n) / (own / n) if own else nan


def _landing(t: np.ndarray, h: np.ndarray, start: int, window: int, slope: float, transition: float) -> int | None:
    below = np.flatnonzero(h[start:] < transition)
    if not len(below):
        return None
    at = start + int(below[0])
    end = min(len(t), at + window)
    if end - at < 2 or not _slope(t[at:end], h[at:end]) < slope:
        return None
    positive = np.flatnonzero(h[at:] > 0)
    return at + int(positive[-1]) if len(positive) else None


def slope_takeoff_landing(t: np.ndarray, h: np.ndarray, window: int = 10, up: float = 10.0, down: float = -10.0, transition: float = 1200.0, margin: float = 500.0) -> tuple[int | None, int | None]:
    """Takeoff and landing positions of an evenly sampled altitude profile; None where there is none.

    Takeoff: the first positive altitude, if the slope before the first sample above the transition is
    steep. Landing: the last positive altitude after the transition is passed downwards steeply. Positions count from the profile's start.
    """
    above = np.flatnonzero(h > transition)
    if not len(above):
        return None, _landing(t, h, 0, window, down, transition)
    at = int(above[0])
    begin = max(0, at - window)
    landing = _landing(t, h, at, window, down, transition)
    if at - begin < 2 or h[at] > transition + margin or not _slope(t[begin:at], h[begin:at]) >= up:
        return None, landing
    positive = np.flatnonzero(h[:at] > 0)
    return (int(positive[0]) if len(positive) else None), landing


def max_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum-weight matching of rows and columns; weights of 0 or less, and nan, never match.

    Shortest augmenting paths with potentials; rows are made the smaller side and every row may stay alone at weight 0.
    """
    w = np.where(np.isfinite(weight) & (weight > 0), weight, 0.0)
    n, m = w.shape
    cost = np.concatenate([-w, np.zeros((n, n))], axis=1)  # a column of its own for each row to stay alone
    m += n
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            slack = cost[row - 1] - u[row] - v[1:]
            free = ~used[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j = nxt
        while j:
            owner[j], j = owner[way[j]], int(way[j])
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m - n + 1) if owner[j] and w[owner[j] - 1, j - 1] > 0)


def sparse_matching(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the pairs of a maximum-weight matching of (row, column, weight); weights of 0 or less never match.

    Rows are taken one by one; each looks along the pairs, by least reduced cost first, for the cheapest way to a free column or to a row that may stay alone
    instead. Memory grows with the pairs.
    """
    near: dict[int, dict[int, int]] = {}
    for k in np.argsort(-weight, kind="stable"):
        if weight[k] > 0:
            near.setdefault(int(rows[k]), {}).setdefault(int(columns[k]), int(k))
    cost = -np.asarray(weight, float)
    at: dict[int, int] = {}  # pair of each matched row
    owner: dict[int, int] = {}  # row of each matched column
    # reduced costs cost - u(row) - v(column) never fall below 0 and are 0 on matched pairs
    u = {r: min(cost[k] for k in ks.values()) for r, ks in near.items()}
    v: dict[int, float] = {}
    for start in near:
        far, via, done, queue = {start: 0.0}, {}, set(), [(0.0, start)]
        reached: dict[int, float] = {}
        # the way may end at a row that gives up its column (cost 0 for it), the start included, or at a free column
        best, end = -u[start], ("row", start)
        while queue:
            d, r = heappop(queue)
            if r in done or d >= best:
                continue
            done.add(r)
            if d - u[r] < best:
                best, end = d - u[r], ("row", r)
            for c, k in near[r].items():
                if at.get(r) == k:
                    continue
                to = d + max(0.0, cost[k] - u[r] - v.get(c, 0.0))
                if to >= reached.get(c, np.inf) or to >= best:
                    continue
                reached[c], via[c] = to, (r, k)
                if c not in owner:
                    best, end = to, ("column", c)
                else:
                    nxt = owner[c]
                    if to < far.get(nxt, np.inf):
                        far[nxt] = to
                        heappush(queue, (to, nxt))
        # potentials: what lies nearer than the end moves by the rest of the way
        for r in done:
            u[r] += best - far[r]
        for c, d in reached.items():
            if c in owner and owner[c] in done:
                v[c] = v.get(c, 0.0) - (best - d)
        kind, x = end
        if kind == "row":
            if x == start:
                continue
            c = int(columns[at.pop(x)])
        else:
            c = x
        while True:
            r, k = via[c]
            old = at.get(r)
            at[r], owner[c] = k, r
            if r == start:
                break
            c = int(columns[old])
    return np.array(sorted(at.values()), np.int64)


def timed_matching(a_t: np.ndarray, a_long: np.ndarray, d_t: np.ndarray, d_long: np.ndarray, worth: np.ndarray, step: float = 3600.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (arrivals, departures) of a maximum-weight matching where ``worth[a_long, d_long, whole steps]`` is a pair's weight; 0 or less and nan never match.

    The same search as :func:`sparse_matching`, but an arrival's pairs are a slice of the departures by time and are worked out when it is reached, so
    memory grows with the rows. Arrivals are taken from the last to the first, which leaves free departures near the next one. Weights are rounded to
    multiples of a power of two (2**-40 for weights below 4096), which makes all sums exact, so equal ways tie.
    """
    ro, co = np.argsort(a_t, kind="stable"), np.argsort(d_t, kind="stable")
    ta, td, steps = a_t[ro], d_t[co], worth.shape[2]
    good = np.isfinite(worth) & (worth > 0)
    none = np.zeros(0, np.int64)
    if not good.any():
        return none, none
    unit = 2.0 ** (52 - int(np.ceil(np.log2(worth[good].max() + 1))))
    table = np.full((2, 2, steps + 2), np.inf)
    table[:, :, :steps][good] = -np.round(worth[good] * unit) / unit
    flat, kind, at = table.reshape(2, -1), a_long[ro].astype(np.int64).tolist(), ta.tolist()
    base_of = d_long[co].astype(np.int64) * (steps + 2)
    lo, hi = np.searchsorted(td, ta, "left").tolist(), np.searchsorted(td, ta + steps * step, "right").tolist()
    n, m = len(ta), len(td)
    u, mate, v, owner = [0.0] * n, [-1] * n, np.zeros(m), np.full(m, -1)
    reached, via = np.full(m, np.inf), np.full(m, -1)

    def costs(r: int) -> np.ndarray:
        own = slice(lo[r], hi[r])
        whole = ((td[own] - at[r]) / step).astype(np.int64)
        return flat[kind[r]].take(whole + base_of[own])

    for start in range(n - 1, -1, -1):
        if lo[start] == hi[start]:
            continue
        u[start] = float(costs(start).min())
        if not u[start] < 0:
            continue
        far, done, queue = {start: 0.0}, [], [(0.0, start)]
        # the way ends at a free column, or at a row that gives up its own
        best, column, row = -u[start], -1, start
        while queue:
            d, r = heappop(queue)
            if d >= best:
                break
            if d > far[r]:
                continue
            done.append(r)
            base = d - u[r]
            if base < best:
                best, column, row = base, -1, r
            a, b = lo[r], hi[r]
            to = costs(r) + base - v[a:b]
            near = np.flatnonzero((to < best) & (to < reached[a:b]))
            if not near.size:
                continue
            to = to[near]
            near += a
            reached[near], via[near] = to, r
            own = owner[near]
            free = np.flatnonzero(own < 0)
            if free.size:
                k = free[to[free].argmin()]
                best, column = float(to[k]), int(near[k])
            for x, y in zip(own.tolist(), to.tolist(), strict=True):
                if y < best and x >= 0 and y < far.get(x, np.inf):
                    far[x] = y
                    heappush(queue, (y, x))
        for r in done:
            u[r] += best - far[r]
            reached[lo[r] : hi[r]] = np.inf
            if mate[r] >= 0:
                v[mate[r]] -= best - far[r]
        if column < 0:
            if row == start:
                continue
            column, mate[row] = mate[row], -1
        while True:
            r = int(via[column])
            owner[column], mate[r], column = r, column, mate[r]
            if r == start:
                break
    mates = np.array(mate, np.int64)
    got = np.flatnonzero(mates >= 0)
    return ro[got], co[mates[got]]


#: Cross products up to this are rounding: coordinates are degrees.
PARALLEL = 1e-9


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): every whole number from low to high of each row."""
    n = (high - low + 1).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def crossings(x: dict[str, np.ndarray], leg: np.ndarray, flight: np.ndarray, alt_m: float, time_s: float, slot_s: float, cell: float, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, lon, lat, t1, t2): positions and crossings of legs ``leg[a] < leg[b]`` of different flights that cross within ``time_s``, with starting altitudes within ``alt_m``, each pair once.

    Legs meet in cells and time slots, as in ``airspace.conflicts``, there by altitude; ``most`` pairs, or those of one leg, are compared at once.
    """
    half, room = time_s / 2, 1e-6
    start, dur, lon0, lat0 = x["from_time"], x["to_time"] - x["from_time"], x["from_lon"], x["from_lat"]
    dlon, dlat = x["to_lon"] - lon0, x["to_lat"] - lat0
    with np.errstate(all="ignore"):
        r, slot = _spread(np.floor((start - half) / slot_s), np.floor((x["to_time"] + half) / slot_s))
        part = lambda t: np.where(dur[r] > 0, np.clip((t - start[r]) / dur[r], 0.0, 1.0), np.nan)
        p0, p1 = np.nan_to_num(part(slot * slot_s - half), nan=0.0), np.nan_to_num(part((slot + 1) * slot_s + half), nan=1.0)
        u, v = lon0[r] + p0 * dlon[r], lon0[r] + p1 * dlon[r]
        k, cx = _spread(np.floor(np.minimum(u, v) / cell - room), np.floor(np.maximum(u, v) / cell + room))
        r, slot, p0, p1 = r[k], slot[k], p0[k], p1[k]
        sides = [((cx + e) * cell - lon0[r]) / dlon[r] for e in (-room, 1 + room)]
        flat = dlon[r] == 0
        west, east = (np.where(flat, own, np.clip(f(*sides), p0, p1)) for f, own in ((np.minimum, p0), (np.maximum, p1)))
        u, v = lat0[r] + west * dlat[r], lat0[r] + east * dlat[r]
        k, cy = _spread(np.floor(np.minimum(u, v) / cell - room), np.floor(np.maximum(u, v) / cell + room))
        r, slot, cx = r[k], slot[k], cx[k]
    if not len(r):
        return
    # the same place and time, by altitude
    code, wide = np.zeros(len(r), np.int64), 1
    for c in (slot, cx, cy):
        c = (c - c.min()).astype(np.int64)
        code, wide = code + c * wide, wide * (int(c.max()) + 1)
    alt = x["from_alt"][r]
    order = np.lexsort((alt, code))
    r, code, alt = r[order], code[order], alt[order]
    slot, cx, cy = slot[order], cx[order], cy[order]
    place = np.cumsum(np.append(0, code[1:] != code[:-1]))
    low, room = alt.min(), float(alt.max() - alt.min()) + 2 * alt_m + 1.0
    height = place * room + (alt - low)
    slack = alt_m * 1e-6 + float(np.spacing(height[-1])) * 4
    end = np.searchsorted(height, height + alt_m + slack, "right")
    count = end - np.arange(len(r)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    row = 0
    while row < len(r):
        to = max(row + 1, int(np.searchsorted(total, total[row] + most, "right")) - 1)
        i = np.repeat(np.arange(row, to), count[row:to])
        j = np.arange(total[row], total[to]) - total[i] + i + 1
        row = to
        a, b = r[i], r[j]
        some = (leg[a] != leg[b]) & (flight[a] != flight[b]) & (np.abs(x["from_alt"][a] - x["from_alt"][b]) <= alt_m)
        i, a, b = i[some], a[some], b[some]
        turn = leg[a] > leg[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        dx, dy, ex, ey = dlon[a], dlat[a], dlon[b], dlat[b]
        wx, wy = lon0[b] - lon0[a], lat0[b] - lat0[a]
        with np.errstate(all="ignore"):
            # legs that are parallel but for rounding don't cross
            den = dx * ey - dy * ex
            t, u = (wx * ey - wy * ex) / den, (wx * dy - wy * dx) / den
            hit = np.flatnonzero((np.abs(den) > PARALLEL) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
        i, a, b, t, u = i[hit], a[hit], b[hit], t[hit], u[hit]
        t1, t2, lon, lat = start[a] + t * dur[a], start[b] + u * dur[b], lon0[a] + t * dlon[a], lat0[a] + t * dlat[a]
        own = (np.abs(t1 - t2) <= time_s) & (np.floor((t1 + t2) / 2 / slot_s) == slot[i]) & (np.floor(lon / cell) == cx[i]) & (np.floor(lat / cell) == cy[i])
        if own.any():
            yield tuple(v[own] for v in (a, b, lon, lat, t1, t2))


def _hooked(parent: np.ndarray) -> np.ndarray:
    """Each place's root, by pointer jumping."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label): every node of edges (a, b) once, and the smallest node of its connected part."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[i], label[j]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[label]
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        parent = np.arange(len(nodes))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        label = _hooked(parent)[label]


def strong_parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label): every node of arcs (a, b) once, and the smallest node of its strongly connected component in them.

    Sources and sinks leave first, for a few rounds; the rest is Tarjan's search.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, n = at[: len(a)], at[len(a) :], len(nodes)
    label = np.arange(n)
    for _ in range(8):
        open_ = (np.bincount(i, minlength=n)[j] > 0) & (np.bincount(j, minlength=n)[i] > 0) & (i != j)
        if open_.all():
            break
        i, j = i[open_], j[open_]
    order = np.argsort(i, kind="stable")
    to, first = j[order].tolist(), np.searchsorted(i[order], np.arange(n + 1)).tolist()
    number, low, stack, on, count = {}, {}, [], set(), 0
    for start in np.unique(i).tolist():
        if start in number:
            continue
        path = [(start, first[start])]
        number[start] = low[start] = count
        count += 1
        stack.append(start)
        on.add(start)
        while path:
            x, k = path.pop()
            if k < first[x + 1]:
                path.append((x, k + 1))
                y = to[k]
                if y not in number:
                    number[y] = low[y] = count
                    count += 1
                    stack.append(y)
                    on.add(y)
                    path.append((y, first[y]))
                elif y in on:
                    low[x] = min(low[x], number[y])
                continue
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[x])
            if low[x] == number[x]:
                k = len(stack) - 1
                while stack[k] != x:
                    k -= 1
                own = stack[k:]
                del stack[k:]
                on.difference_update(own)
                label[own] = min(own)
    return nodes, nodes[label]


def forest_rows(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of the maximum spanning forest of (a, b, w); of equal weights that of the smaller ends, by Boruvka's rounds."""
    order = np.lexsort((b, a, np.where(np.isnan(w), -np.inf, -w)))
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    live, kept = np.arange(len(a)), []
    while True:
        x, y = label[i[live]], label[j[live]]
        open_ = x != y
        live, x, y = live[open_], x[open_], y[open_]
        if not len(live):
            return order[np.unique(np.concatenate(kept))] if kept else np.zeros(0, np.int64)
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        roots = np.flatnonzero(best < len(a))
        edge = best[roots]
        kept.append(edge)
        parent = np.arange(len(nodes))
        parent[roots] = np.where(label[i[edge]] == roots, label[j[edge]], label[i[edge]])
        # two parts that take the same edge: the smaller one is the root
        root = roots[(parent[parent[roots]] == roots) & (roots < parent[roots])]
        parent[root] = root
        label = _hooked(parent)[label]


def _crossed(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(k, i, j): every i of the range of n[k] from a[k] with every j of the range of m[k] from b[k], a bounded number of them at once unless one k has more."""
    each = n * m
    total = np.concatenate([[0], np.cumsum(each)])
    k = 0
    while k < len(each):
        to = max(k + 1, int(np.searchsorted(total, total[k] + most, "right")) - 1)
        pair = np.repeat(np.arange(k, to), each[k:to])
        at = np.arange(total[k], total[to]) - total[pair]
        yield pair, a[pair] + at // m[pair], b[pair] + at % m[pair]
        k = to


def density_clusters(x: np.ndarray, eps: float, least: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(core, cluster) of points of one or two coordinates, a row each: whether a point is a core, and the position of the first core of its cluster, -1 for noise.

    A core has ``least`` points within ``eps``, itself included; cores within ``eps`` of each other are in one cluster, any other point goes to that of its first neighbouring core.
    Only where ``known`` points may be cores. Points stand in cells so small that all of one cell are neighbours, and so are all of two cells whose boxes lie close, so
    points are compared one by one only near ``eps``, and only while it isn't known yet whether they are cores or in one cluster.
    """
    n, d = x.shape
    core, cluster = np.zeros(n, bool), np.full(n, -1)
    if not n:
        return core, cluster
    cell = np.floor((x - x.min(axis=0)) / (eps / math.sqrt(d) * (1 - 1e-6))).astype(np.int64)
    reach = 1 if d == 1 else 2
    width = cell.max(axis=0)[-1] + 2 * reach + 1
    code = cell[:, 0] * width + cell[:, 1] if d == 2 else cell[:, 0]
    order = np.argsort(code, kind="stable")
    codes, start, count = np.unique(code[order], return_index=True, return_counts=True)
    p = x[order]
    low, high = np.minimum.reduceat(p, start), np.maximum.reduceat(p, start)
    steps = [k for k in range(-reach, reach + 1)] if d == 1 else [i * width + j for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    near = [(c, at) for step in steps for at in [np.searchsorted(codes, codes + step)] for c in [np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == codes + step)] for at in [at[c]]]
    a, b = (np.concatenate(v) for v in zip(*near, strict=True))
    gap = np.sqrt((np.maximum(np.maximum(low[a] - high[b], low[b] - high[a]), 0.0) ** 2).sum(axis=1))
    span = np.sqrt((np.maximum(high[a] - low[b], high[b] - low[a]) ** 2).sum(axis=1))
    all_, some = span <= eps * (1 - 1e-12), gap <= eps * (1 + 1e-12)
    some &= ~all_
    close = lambda i, j: np.sqrt(((p[i] - p[j]) ** 2).sum(axis=1)) <= eps

    sure = np.bincount(a[all_], count[b[all_]], len(codes))
    owns = np.repeat(np.arange(len(codes)), count)
    found = sure[owns]
    ask = some & (sure[a] < least)
    for _, i, j in _crossed(start[a[ask]], count[a[ask]], start[b[ask]], count[b[ask]]):
        found += np.bincount(i[close(i, j)], minlength=n)
    is_core = (found >= least) & known[order]

    # cores of a cell, in order, and the cells joined
    cores = np.flatnonzero(is_core)
    held = np.bincount(owns[cores], minlength=len(codes))
    begin = np.concatenate([[0], np.cumsum(held)[:-1]])
    both = (held[a] > 0) & (held[b] > 0) & (a < b)
    parent = list(range(len(codes)))

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    def join(left: np.ndarray, right: np.ndarray) -> None:
        for u, v in zip(left.tolist(), right.tolist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)

    join(a[both & all_], b[both & all_])
    ask = np.flatnonzero(both & some)
    few = held[a[ask]] * held[b[ask]] <= 64
    for k, i, j in _crossed(*(v[c[ask[few]]] for c in (a, b) for v in (begin, held))):
        hit = np.unique(ask[few][k[close(cores[i], cores[j])]])
        join(a[hit], b[hit])
    for k in ask[~few].tolist():
        u, v = int(a[k]), int(b[k])
        if root(u) == root(v):
            continue
        # only cores within reach of the other cell's box may meet
        i, j = (cores[begin[c] : begin[c] + held[c]] for c in (u, v))
        i, j = (own[np.sqrt((np.maximum(np.maximum(low[o] - p[own], p[own] - high[o]), 0.0) ** 2).sum(axis=1)) <= eps * (1 + 1e-12)] for own, o in ((i, v), (j, u)))
        rows = max(1, (1 << 18) // max(1, len(j)))
        for at in range(0, len(i), rows):
            if (np.sqrt(((p[i[at : at + rows], None] - p[j][None]) ** 2).sum(axis=2)) <= eps).any():
                join(a[[k]], b[[k]])
                break

    first = np.full(len(codes), n)
    roots = np.array([root(c) for c in range(len(codes))])
    np.minimum.at(first, roots[owns[cores]], order[cores])
    label = np.where(is_core, first[roots[owns]], -1)
    # the others: the first of the cores in reach, by position
    other = np.flatnonzero(~is_core)
    if len(other) and len(cores):
        lone = np.bincount(owns[other], minlength=len(codes))
        put = np.concatenate([[0], np.cumsum(lone)[:-1]])
        best = np.full(n, n)
        ask = (lone[a] > 0) & (held[b] > 0) & (all_ | some)
        for k, i, j in _crossed(put[a[ask]], lone[a[ask]], begin[b[ask]], np.where(all_[ask], 1, held[b[ask]])):
            i, j = other[i], cores[j]
            hit = all_[ask][k] | close(i, j)
            np.minimum.at(best, i[hit], order[j[hit]])
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        got = other[best[other] < n]
        label[got] = label[at[best[got]]]
    core[order], cluster[order] = is_core, label
    return core, cluster


class Tree:
    """A k-d tree over points of the plane: each node halves its points by the wider extent, leaves hold a few."""

    LEAF = 16

    def __init__(self, x: np.ndarray, y: np.ndarray, no: np.ndarray):
        self.xy, self.no = np.column_stack([x, y]).astype(float), np.asarray(no)
        self.order = np.arange(len(self.xy))
        ranges, children = [(0, len(self.xy))] if len(self.xy) else [], []
        low, high, k = [], [], 0
        while k < len(ranges):
            a, b = ranges[k]
            own = self.xy[self.order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            children.append((-1, -1))
            if b - a > self.LEAF and (high[-1] > low[-1]).any():
                axis, mid = int(np.argmax(high[-1] - low[-1])), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                children[-1] = (len(ranges), len(ranges) + 1)
                ranges += [(a, a + mid), (a + mid, b)]
            k += 1
        #: Of each node its range of the order, its children (-1 in leaves), and its box.
        self.ranges, self.children, self.low, self.high = np.array(ranges), np.array(children), np.array(low), np.array(high)

    def _off(self, node: int, asked: np.ndarray) -> np.ndarray:
        """Squared distances to a node's box."""
        gap = np.maximum(np.maximum(self.low[node] - asked, asked - self.high[node]), 0.0)
        return (gap * gap).sum(axis=1)

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, position) of the point nearest to each asked one; ties to the smaller number, -1 where there is none."""
        asked = np.column_stack([x, y]).astype(float)
        best, at = np.full(len(asked), np.inf), np.full(len(asked), -1)
        stack = [(0, np.flatnonzero(np.isfinite(asked).all(axis=1)))] if len(self.ranges) else []
        while stack:
            node, who = stack.pop()
            who = who[np.sqrt(self._off(node, asked[who])) <= best[who]]
            if not len(who):
                continue
            left, right = map(int, self.children[node])
            if left >= 0:
                # the nearer half comes first; the other one is looked at with what is known then
                first = self._off(left, asked[who]) <= self._off(right, asked[who])
                stack += [(left, who[~first]), (right, who[first]), (right, who[~first]), (left, who[first])]
                continue
            own = self.order[slice(*self.ranges[node])]
            d = np.sqrt(((asked[who, None] - self.xy[own][None]) ** 2).sum(axis=2))
            least = d.min(axis=1)
            pick = own[np.where(d == least[:, None], self.no[own], np.iinfo(np.int64).max).argmin(axis=1)]
            better = (least < best[who]) | ((least == best[who]) & (self.no[pick] < self.no[at[who]]))
            best[who[better]], at[who[better]] = least[better], pick[better]
        return best, at


def spectral_embedding(sim: np.ndarray, dims: int = 2) -> np.ndarray:
    """Coordinates from the first nontrivial eigenvectors of the normalised Laplacian; the largest entry of each is positive."""
    degree = sim.sum(axis=1)
    scale = 1 / np.sqrt(np.maximum(degree, 1e-12))
    lap = np.eye(len(sim)) - scale[:, None] * sim * scale[None, :]
    _, vec = np.linalg.eigh(lap)
    out = vec[:, 1 : dims + 1] * scale[:, None]
    return out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])


def connected_threshold(sim: np.ndarray) -> float:
    """The largest value that keeps all nodes connected by similarities above it: the largest value below the weakest edge of the maximum spanning tree."""
    n = len(sim)
    if n < 2:
        return float(np.max(sim, initial=0.0))
    best, inside, weakest = sim[0].astype(float).copy(), np.zeros(n, bool), np.inf
    inside[0] = True
    for _ in range(n - 1):
        k = int(np.argmax(np.where(inside, -np.inf, best)))
        weakest = min(weakest, best[k])
        inside[k] = True
        best = np.maximum(best, sim[k])
    values = np.unique(sim)
    below = values[values < weakest]
    return float(below[-1]) if len(below) else float(values[-1])


def base_thresholds(low: float, high: float, share: float = 0.75, steps: int = 10) -> list[float]:
    """Thresholds that climb from the connected one towards the highest value; each step starts from the last threshold."""
    out = []
    for p in np.linspace(0.0, share, steps):
        low = low + (high - low) * p
        out.append(low)
    return out


def cpm_communities(edges: list[tuple[int, int, float]], gamma: float, seed: int = 1, rounds: int = 50) -> dict[int, int]:
    """Communities of a weighted graph by local moves that raise the constant-Potts quality; disconnected ones are split.

    A node moves to the neighbouring community with the largest gain over staying, if positive; nodes are
    visited in a seeded order until nothing moves. A community is named by its smallest node.
    """
    near: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        if a != b:
            near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
            near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + w
    nodes = sorted(near)
    home, size = {v: v for v in nodes}, {v: 1 for v in nodes}
    order = np.random.default_rng(seed).permutation(len(nodes))
    for _ in range(rounds):
        moved = False
        for k in order:
            v = nodes[k]
            into: dict[int, float] = {}
            for x, w in near[v].items():
                into[home[x]] = into.get(home[x], 0.0) + w
            own = home[v]
            stay = into.get(own, 0.0) - gamma * (size[own] - 1)
            gain, best = max(((w - gamma * size[c] - stay, -c) for c, w in into.items() if c != own), default=(0.0, 0))
            if gain > 1e-12:
                size[own] -= 1
                home[v], moved = -best, True
                size[-best] += 1
        if not moved:
            break
    out: dict[int, int] = {}
    for v in nodes:  # connected parts of each community, named by their smallest node
        if v not in out:
            stack, out[v] = [v], v
            while stack:
                for x in near[stack.pop()]:
                    if x not in out and home[x] == home[v]:
                        out[x] = v
                        stack.append(x)
    return out


def settled_homes(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, gamma: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(node, community) of the nodes 0 to n - 1 that edges (i, j, w) touch, by the moves of :func:`cpm_communities` on arrays, until no node gains.

    Between two passes over all nodes only those are looked at again that have a neighbour which moved.
    """
    order = np.argsort(np.concatenate([i, j]), kind="stable")
    to, weight = np.concatenate([j, i])[order], np.concatenate([w, w])[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n) + np.bincount(j, minlength=n))])
    del order
    ends = np.flatnonzero(np.diff(first))
    turn = np.random.default_rng(seed).permutation(ends)
    home, size = np.arange(n), np.ones(n)
    first_of = first.tolist()
    open_, whole = turn, True
    while True:
        again = np.zeros(n, bool)
        for v in open_.tolist():
            near = slice(first_of[v], first_of[v + 1])
            into = np.bincount(home[to[near]], weight[near], n)
            own = home[v]
            stay = into[own] - gamma * (size[own] - 1)
            worth = np.where(into > 0, into - gamma * size, -np.inf)
            worth[own] = -np.inf
            best = int(worth.argmax())
            if worth[best] - stay > 1e-9:
                size[own] -= 1
                size[best] += 1
                home[v] = best
                again[to[near]] = True
        if again.any():
            open_, whole = turn[again[turn]], False
        elif whole:
            break
        else:
            open_, whole = turn, True
    inner = home[i] == home[j]
    label = np.arange(n)
    if inner.any():
        node, least = stars(i[inner], j[inner])
        label[node] = least
    return ends, label[ends]


def route_search(scores: list[dict[int, float]], first: dict[int, float], ends: dict[int, tuple[int, int]], most: int = 5, least: float = 0.3) -> list[tuple[list[int], float]]:
    """Routes of edges that match the legs in order, best score first at each step; the first ``most`` found, by total.

    ``first``: scores of the first leg; ``scores``: of every later leg, by edge; ``ends``: nodes of each edge.
    """
    leaving: dict[int, list[int]] = {}
    for e in sorted(ends):
        leaving.setdefault(ends[e][0], []).append(e)
    found: list[tuple[list[int], float]] = []
    ranked = lambda xs: sorted(xs, key=lambda x: -x[1])
    stack = [([e], s) for e, s in reversed(ranked([(e, s) for e, s in sorted(first.items()) if s > least]))]
    while stack and len(found) < most:
        route, total = stack.pop()
        if len(route) > len(scores):
            found.append((route, total))
            continue
        here = scores[len(route) - 1]
        nexts = [(e, here[e]) for e in [*leaving.get(ends[route[-1]][1], []), route[-1]] if here.get(e, 0.0) > least]
        stack.extend(([*route, e], total + s) for e, s in reversed(ranked(nexts)))
    return sorted(found, key=lambda x: -x[1])


def top_routes(scores: list[dict[int, float]], first: dict[int, float], ends: dict[int, tuple[int, int]], most: int = 5, least: float = 0.3) -> list[tuple[list[int], float]]:
    """The ``most`` routes with the highest totals, exactly: the best partial routes of each last edge are carried from leg to leg."""
    held = {e: [(s, [e])] for e, s in first.items() if s > least}
    for here in scores:
        nxt: dict[int, list] = {}
        for e, partial in held.items():
            for f, s in here.items():
                if s > least and (f == e or ends[f][0] == ends[e][1]):
                    nxt.setdefault(f, []).extend((t + s, [*r, f]) for t, r in partial)
        held = {e: sorted(x, key=lambda p: (-p[0], p[1]))[:most] for e, x in nxt.items()}
    every = sorted((p for x in held.values() for p in x), key=lambda p: (-p[0], p[1]))
    return [(r, t) for t, r in every[:most]]
