"""Polygons as lists of numpy rings: shared area of many pairs at once, the outline of what rings cover, and cutting into pieces."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Pairs of triangles that are worked out at once, edges in a cell of a grid that is not gridded again, and crossings of edges and slabs held at once.
MOST_PAIRS, CROWD, MOST_HELD = 1 << 16, 48, 1 << 19
#: Areas below are rounding where edges touch; corners closer than this are one.
LEAST_AREA, GRAIN = 1e-6, 1e-6


def triangles(rings: list[np.ndarray], origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings as triangles around their first corners (counter-clockwise, n x 3 x 2) and the sign of each."""
    parts = [np.stack([np.broadcast_to(r[0], (len(r) - 2, 2)), r[1:-1], r[2:]], axis=1) for r in rings]
    t = np.concatenate([np.zeros((0, 3, 2)), *parts]) - origin
    u, v = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    double = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    t = np.where((double < 0)[:, None, None], t[:, ::-1], t)
    return t[double != 0], np.sign(double[double != 0])


def cut_edges(own: np.ndarray, other: np.ndarray, keep_shared: bool) -> np.ndarray:
    """Twice the signed area under the parts of own triangles' edges that lie in the other triangles."""
    start = own[:, :, None]
    way = np.roll(own, -1, axis=1)[:, :, None] - start
    side, edge = other[:, None], np.roll(other, -1, axis=1)[:, None] - other[:, None]
    cross = lambda a, b: a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
    at, slope = cross(edge, start - side), cross(edge, np.broadcast_to(way, np.broadcast_shapes(way.shape, edge.shape)))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -at / slope
    lo = np.where(slope > 0, t, 0.0).max(axis=2).clip(0, 1)
    hi = np.where(slope < 0, t, 1.0).min(axis=2).clip(0, 1)
    same_way = (edge * way).sum(axis=-1) > 0
    outside = (slope == 0) & ((at < 0) | ((at == 0) & ~(keep_shared & same_way)))
    hi = np.where(outside.any(axis=2), lo, np.maximum(lo, hi))
    a, d = own, np.roll(own, -1, axis=1) - own
    first, last = a + d * lo[..., None], a + d * hi[..., None]
    return cross(first, last).sum(axis=1)


def overlaps(left: list[list[np.ndarray]], right: list[list[np.ndarray]]) -> np.ndarray:
    """Shared area of each pair of polygons; 0 if either has no ring."""
    out = np.zeros(len(left))
    rows, first, second, signs = [], [], [], []

    def settle() -> None:
        if rows:
            a, b = np.concatenate(first), np.concatenate(second)
            shared = (cut_edges(a, b, True) + cut_edges(b, a, False)) / 2
            np.add.at(out, np.concatenate(rows), np.concatenate(signs) * shared)
            for x in (rows, first, second, signs):
                x.clear()

    held = 0
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if not a or not b:
            continue
        origin = a[0].min(axis=0)
        (t, s), (u, v) = triangles(a, origin), triangles(b, origin)
        for at in range(0, len(t), max(1, MOST_PAIRS // max(1, len(u)))):
            some, sign = t[at : at + max(1, MOST_PAIRS // max(1, len(u)))], s[at : at + max(1, MOST_PAIRS // max(1, len(u)))]
            n = len(some) * len(u)
            rows.append(np.full(n, i))
            first.append(np.repeat(some, len(u), axis=0))
            second.append(np.tile(u, (len(some), 1, 1)))
            signs.append(np.repeat(sign, len(u)) * np.tile(v, len(some)))
            held += n
            if held >= MOST_PAIRS:
                settle()
                held = 0
    settle()
    out = np.abs(out)
    return np.where(out > LEAST_AREA, out, 0.0)


def cells_of(edges: np.ndarray, low: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(edge, cell) for the cells of an n x n grid that each edge goes through, from its part within each column."""
    x1, y1, x2, y2 = edges.T
    slack = 1e-9 * size + 1e-12
    left, right = np.minimum(x1, x2), np.maximum(x1, x2)
    first, last = np.floor((left - slack[0] - low[0]) / size[0]).clip(0, n), np.floor((right + slack[0] - low[0]) / size[0]).clip(-1, n - 1)
    many = np.maximum(last - first + 1, 0).astype(np.int64)
    own = np.repeat(np.arange(len(edges)), many)
    column = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + first[own].astype(np.int64)
    start = low[0] + column * size[0] - slack[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(x2 != x1, (y2 - y1) / (x2 - x1), 0.0)[own]
    at = lambda x: np.where((x2 != x1)[own], y1[own] + (np.clip(x, left[own], right[own]) - x1[own]) * slope, y1[own])
    a, b = at(start), np.where((x2 != x1)[own], at(start + size[0] + 2 * slack[0]), y2[own])
    first, last = (np.floor((f(a, b) + t * slack[1] - low[1]) / size[1]) for f, t in ((np.minimum, -1), (np.maximum, 1)))
    first, last = first.clip(0, n), last.clip(-1, n - 1)
    many = np.maximum(last - first + 1, 0).astype(np.int64)
    row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many).astype(np.int64)
    return np.repeat(own, many), np.repeat(column, many) * n + row


def near_edges(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges that may cross, some more than once: those in one cell of a grid with about as many cells as edges; crowded cells get grids of their own."""
    if not len(edges):
        return
    ends = edges.reshape(-1, 2)
    waiting = [(np.arange(len(edges)), ends.min(axis=0), ends.max(axis=0), 0)]
    while waiting:
        own, low, high, depth = waiting.pop()
        n = max(2, min(512, int(len(own) ** 0.5)))
        size = np.maximum((high - low) / n, 1e-9)
        edge, cell = cells_of(edges[own], low, size, n)
        order = np.argsort(cell, kind="stable")
        edge, cell = own[edge[order]], cell[order]
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        many = np.diff(np.append(begins, len(cell)))
        place = np.arange(len(cell)) - np.repeat(begins, many)
        few = np.repeat(many <= CROWD, many)
        for step in range(1, int(many[many <= CROWD].max(initial=1))):
            second = np.flatnonzero(few & (place >= step))
            if len(second):
                yield edge[second - step], edge[second]
        for k in np.flatnonzero(many > CROWD).tolist():
            crowd = edge[begins[k] : begins[k] + many[k]]
            if depth < 12 and len(crowd) < 0.9 * len(own):
                corner = low + size * np.array([cell[begins[k]] // n, cell[begins[k]] % n])
                waiting.append((crowd, corner - 1e-9 * size, corner + size * (1 + 1e-9), depth + 1))
            else:  # they all meet in a spot
                for i in range(1, len(crowd)):
                    yield np.repeat(crowd[i], i), crowd[:i]


def crossings(edges: np.ndarray) -> list[np.ndarray]:
    """Heights at which edges (x1, y1, x2, y2) cross between their ends."""
    found = []
    p, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    for i, j in near_edges(edges):
        gap, u, v = p[j] - p[i], d[i], d[j]
        base = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * v[:, 1] - gap[:, 1] * v[:, 0]) / base
            s = (gap[:, 0] * u[:, 1] - gap[:, 1] * u[:, 0]) / base
        hit = (base != 0) & (t > 0) & (t < 1) & (s > 0) & (s < 1)
        found.append(p[i][hit, 1] + t[hit] * u[hit, 1])
    return found


def repair(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings that neither cross nor lie in others of their kind as they are, else the outline of all rings."""
    areas = np.array([x @ np.roll(y, -1) - y @ np.roll(x, -1) for x, y in (r.T for r in rings)])
    edges = np.concatenate([np.zeros((0, 4)), *(np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings)])
    if areas.all() and boxes_apart([r for r, a in zip(rings, areas, strict=True) if a > 0]) and boxes_apart([r for r, a in zip(rings, areas, strict=True) if a < 0]) and not any(map(len, crossings(edges))):
        return rings
    return dissolve(rings)


def boxes_apart(rings: list[np.ndarray]) -> bool:
    if len(rings) < 2:
        return True
    low, high = (np.array([f(r, axis=0) for r in rings]) for f in (np.min, np.max))
    meet = ((low[:, None] <= high[None]) & (low[None] <= high[:, None])).all(axis=-1)
    return int(meet.sum()) == len(rings)


def heights(edges: np.ndarray) -> np.ndarray:
    """The different heights at which edges end or cross."""
    ys = np.unique(np.concatenate([edges[:, 1], edges[:, 3], *crossings(edges)]))
    return ys[np.concatenate([[True], np.diff(ys) > GRAIN / 10])] if len(ys) else ys


def dissolve(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The outline of all places that rings wind around: outer rings counter-clockwise, holes clockwise, corners on straight lines left out.

    Between two heights at which edges end or cross no edges cross, so each such slab is a row of trapezoids; their outer sides are joined to rings.
    """
    every = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings]
    edges = np.concatenate([np.zeros((0, 4)), *every])
    edges = edges[edges[:, 1] != edges[:, 3]]
    if not len(edges):
        return []
    wind = np.where(edges[:, 3] > edges[:, 1], -1, 1)
    up = np.where((wind < 0)[:, None], edges, edges[:, [2, 3, 0, 1]])  # from the lower end
    ys = heights(edges)
    # the slabs of each edge, from the first to the last
    first, last = np.searchsorted(ys, up[:, 1] + GRAIN / 20, side="right") - 1, np.searchsorted(ys, up[:, 3] - GRAIN / 20, side="left") - 1
    first = np.maximum(first, 0)
    active = np.cumsum(np.bincount(first, minlength=len(ys) + 1) - np.bincount(np.maximum(last + 1, first), minlength=len(ys) + 1)[: len(ys) + 1])
    done = np.cumsum(active)
    sides, covers, at = [], [], 0
    while at < len(ys) - 1:  # as many slabs at once as have MOST_HELD edges, one at least
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + MOST_HELD, side="right")))
        some = np.flatnonzero((first < to) & (last >= at) & (last >= first))
        more, cover = slab_sides(up[some], wind[some], np.maximum(first[some], at), np.minimum(last[some], to - 1), ys)
        sides += more
        covers.append(cover)
        at = to
    return joined(np.concatenate([*sides, level_sides(np.concatenate(covers), ys)]))


def slab_sides(up: np.ndarray, wind: np.ndarray, first: np.ndarray, last: np.ndarray, ys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The outer sides (x1, y1, x2, y2) of the trapezoids in some slabs, and what they cover of the slabs' ends: height number, from, to, and 1 above it or 0 below it."""
    many = last - first + 1
    edge = np.repeat(np.arange(len(up)), many)
    slab = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    low, high, e = ys[slab], ys[slab + 1], up[edge]
    x = lambda y: e[:, 0] + (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1])
    x_low, x_high = x(low), x(high)
    order = np.lexsort((x_low + x_high, slab))
    slab, low, high, x_low, x_high, turn = slab[order], low[order], high[order], x_low[order], x_high[order], wind[edge][order]
    total = np.cumsum(turn)
    begins = np.flatnonzero(np.diff(slab, prepend=-1))
    total -= np.repeat((total - turn)[begins], np.diff(np.append(begins, len(slab))))
    before = total - turn
    total[np.append(begins[1:], len(slab)) - 1] = 0  # where rounding has lost an edge, too
    opens, closes = np.flatnonzero((before == 0) & (total != 0)), np.flatnonzero((before != 0) & (total == 0))
    if len(opens) > 1:  # what ends on the line where the next begins goes on
        gap = np.maximum(np.abs(x_low[opens[1:]] - x_low[closes[:-1]]), np.abs(x_high[opens[1:]] - x_high[closes[:-1]]))
        apart = (gap > GRAIN) | (slab[opens[1:]] != slab[closes[:-1]])
        opens, closes = opens[np.concatenate([[True], apart])], closes[np.concatenate([apart, [True]])]
    sides, edge = [], edge[order]
    for some, down in ((opens, True), (closes, False)):  # an edge that is an outer side in slabs one after the other is one side
        some = some[np.lexsort((slab[some], edge[some]))]
        fresh = np.concatenate([[True], (edge[some[1:]] != edge[some[:-1]]) | (slab[some[1:]] != slab[some[:-1]] + 1)])[: len(some)]
        bottom, top = some[fresh], some[np.append(fresh[1:], True)[: len(some)]]
        ends = [x_low[bottom], low[bottom], x_high[top], high[top]]
        sides.append(np.stack(ends[2:] + ends[:2] if down else ends, axis=1))
    cover = [np.stack([slab[opens] + up_by, x[opens], x[closes], np.full(len(opens), over)], axis=1) for up_by, x, over in ((0, x_low, 1), (1, x_high, 0))]
    return sides, np.concatenate(cover)


def level_sides(covers: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Horizontal sides where only what is below (run to the left) or only what is above (run to the right) a height is covered."""
    number, over = np.tile(covers[:, 0].astype(np.int64), 2), np.tile(covers[:, 3] == 1, 2)
    x, change = np.concatenate([covers[:, 1], covers[:, 2]]), np.repeat([1, -1], len(covers))
    order = np.lexsort((x, number))
    number, x, over, change = number[order], x[order], over[order], change[order]
    above, below = np.cumsum(np.where(over, change, 0)) > 0, np.cumsum(np.where(over, 0, change)) > 0
    here = np.flatnonzero((number[1:] == number[:-1]) & (x[1:] - x[:-1] > GRAIN / 10) & (above[:-1] != below[:-1]))
    left, right, y = x[here], x[here + 1], ys[number[here]]
    return np.where(above[here][:, None], np.stack([left, y, right, y], axis=1), np.stack([right, y, left, y], axis=1))


def joined(sides: np.ndarray) -> list[np.ndarray]:
    """Rings from directed sides (x1, y1, x2, y2)."""
    name = lambda p: (round(p[0] / GRAIN), round(p[1] / GRAIN))
    names = np.round(sides / GRAIN)
    apart = (names[:, :2] != names[:, 2:]).any(axis=1)
    nexts: dict[tuple, list] = defaultdict(list)
    for a, b in zip(map(tuple, names[apart, :2].astype(np.int64).tolist()), map(tuple, sides[apart, 2:].tolist()), strict=True):
        nexts[a].append(b)
    around = [(0, 0), *((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)]  # rounding may have put one corner at two names
    out = []
    for begin in list(nexts):
        while nexts[begin]:
            ring, place, way = [], begin, None
            while True:
                choice = next((x for i, j in around if (x := nexts.get((place[0] + i, place[1] + j)))), [])
                if way is not None and len(choice) > 1:  # the sharpest turn to the left keeps parts that touch in a corner apart
                    here = np.array(ring[-1])
                    turn = [np.arctan2(way[0] * (b[1] - here[1]) - way[1] * (b[0] - here[0]), way[0] * (b[0] - here[0]) + way[1] * (b[1] - here[1])) for b in choice]
                    to = choice.pop(int(np.argmax(turn)))
                elif choice:
                    to = choice.pop()
                else:
                    break
                here = ring[-1] if ring else (begin[0] * GRAIN, begin[1] * GRAIN)
                way = (to[0] - here[0], to[1] - here[1])
                ring.append(to)
                place = name(to)
                if place == begin or (not nexts.get(place) and abs(place[0] - begin[0]) <= 1 and abs(place[1] - begin[1]) <= 1):
                    break
            ring = straightened(np.array(ring))
            if len(ring) > 2:
                out.append(ring)
    return out


def straightened(ring: np.ndarray) -> np.ndarray:
    """A ring without corners on straight lines."""
    while len(ring) > 2:
        before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
        keep = bend > 1e-9 * np.maximum(1.0, np.linalg.norm(before, axis=1) * np.linalg.norm(after, axis=1))
        if keep.all():
            return ring
        ring = ring[keep]
    return ring[:0]


def cut(rings: list[np.ndarray], axis: int, at: float, above: bool) -> list[np.ndarray]:
    """What of the rings is on one side of a line across an axis; parts that are cut off from each other stay joined along the line."""
    out = []
    for ring in rings:
        inside = ring[:, axis] >= at if above else ring[:, axis] <= at
        nexts = np.roll(ring, -1, axis=0)
        through = inside != np.roll(inside, -1)
        if not through.any():
            out += [ring] if inside.all() else []
            continue
        share = (at - ring[through, axis]) / (nexts - ring)[through, axis]
        spots = ring[through] + share[:, None] * (nexts - ring)[through]
        spots[:, axis] = at
        order = np.argsort(np.concatenate([np.flatnonzero(inside) * 2, np.flatnonzero(through) * 2 + 1]))
        out.append(np.concatenate([ring[inside], spots])[order])
    return [x for x in out if len(x) > 2]


def pieces(rings: list[np.ndarray], most: int) -> list[list[np.ndarray]]:
    """A polygon in pieces of at most about `most` corners, cut at the middle corner along the longer side of its box, again and again."""
    out, waiting = [], [(rings, 0)]
    while waiting:
        own, depth = waiting.pop()
        if sum(map(len, own)) <= most or depth > 60:
            clean = dissolve(own) if depth else own
            out += [clean] if clean else []
            continue
        spots = np.concatenate(own)
        axis = int(np.argmax(np.ptp(spots, axis=0)))
        at = float(np.median(spots[:, axis]))
        waiting += [(cut(own, axis, at, above), depth + 1) for above in (False, True)]
    return out
