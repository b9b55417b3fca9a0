"""The path-search kernel: literal routes, and properties over random meshes."""

import heapq
import math
import random

import pytest

from wayloom.functions.navmesh import GOAL_OFF, START_OFF, UNREACHABLE, Mesh


def trap(plane, idx, y0, y1, xbl, xbr, xtl=None, xtr=None):
    return (plane, idx, y1, y0, xbl if xtl is None else xtl, xbr if xtr is None else xtr, xbl, xbr)


ROOM = [trap(0, 0, 0.0, 8.0, 0.0, 4.0), trap(0, 1, 0.0, 8.0, 6.0, 10.0), trap(0, 2, 8.0, 10.0, 0.0, 10.0)]
ROOM_GATES = [(0, 0, 0, 2, "top", 0.0, 8.0, 4.0, 8.0), (0, 2, 0, 0, "bottom", 0.0, 8.0, 4.0, 8.0), (0, 1, 0, 2, "top", 6.0, 8.0, 10.0, 8.0), (0, 2, 0, 1, "bottom", 6.0, 8.0, 10.0, 8.0)]


@pytest.mark.parametrize("prune", [True, False])
def test_room(prune):
    error, length, points = Mesh(ROOM, ROOM_GATES, prune).route((1.0, 1.0), 0, (9.0, 1.0), 0)
    assert error is None
    assert [p[:2] for p in points] == [(1.0, 1.0), (4.0, 8.0), (6.0, 8.0), (9.0, 1.0)]
    assert length == pytest.approx(2 * math.sqrt(58) + 2)


def test_portal():
    traps = [trap(0, 0, 0.0, 10.0, 0.0, 4.0), trap(1, 0, 6.0, 10.0, 4.0, 8.0)]
    gates = [(0, 0, 1, 0, "right", 4.0, 6.0, 4.0, 10.0), (1, 0, 0, 0, "left", 4.0, 6.0, 4.0, 10.0)]
    error, _, points = Mesh(traps, gates).route((1.0, 1.0), 0, (7.0, 9.0), 1)
    assert error is None and [p[:2] for p in points] == [(1.0, 1.0), (4.0, 6.0), (7.0, 9.0)] and points[-1][2] == 1
    assert Mesh(traps, []).route((1.0, 1.0), 0, (7.0, 9.0), 1)[0] == UNREACHABLE


def test_off_mesh():
    m = Mesh(ROOM, ROOM_GATES)
    assert m.route((50.0, 1.0), 0, (9.0, 1.0), 0)[0] == START_OFF
    assert m.route((1.0, 1.0), 0, (5.0, 1.0), 0)[0] == GOAL_OFF
    assert m.route((1.0, 1.0), 0, (3.0, 2.0), 0)[1] == pytest.approx(math.hypot(2, 1))


def random_mesh(rng, rows=5):
    """Rows of disjoint trapezoids, gates where those of neighbouring rows share a stretch."""
    traps, by_row, idx = [], [], 0
    for r in range(rows):
        cuts = sorted(rng.sample(range(0, 40), 6))
        here = []
        for a, b in zip(cuts[::2], cuts[1::2]):
            if b - a >= 2:
                here.append(trap(0, idx, 10.0 * r, 10.0 * r + 10, float(a), float(b), a + rng.choice([0, 0, 0.5]), b - rng.choice([0, 0, 0.5])))
                idx += 1
        by_row.append(here)
        traps += here
    gates = []
    for below, above in zip(by_row, by_row[1:]):
        for t in below:
            for u in above:
                lo, hi = max(t[4], u[6]), min(t[5], u[7])
                if hi == lo:  # they touch in a point, which is no gate but fools the brute force
                    return [], []
                if hi > lo:
                    gates += [(0, t[1], 0, u[1], "top", lo, t[2], hi, t[2]), (0, u[1], 0, t[1], "bottom", lo, t[2], hi, t[2])]
    return traps, gates


def visibility_length(traps, gates, start, goal, mesh):
    """Brute force: Dijkstra over all gate ends and a fine sampling of each straight step's way through gates."""
    points = [start, goal, *{p for g in gates for p in ((g[5], g[6]), (g[7], g[8]))}]

    def clear(a, b):
        n = max(2, int(math.hypot(a[0] - b[0], a[1] - b[1]) * 25))
        for k in range(n + 1):
            p = (a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n)
            if not any(mesh.holds(i, p, 1e-6) for i in range(len(mesh.traps))):
                return False
        return True

    dist, heap, done = {0: 0.0}, [(0.0, 0)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == 1:
            return d
        for v in range(len(points)):
            if v not in done and clear(points[u], points[v]):
                c = d + math.hypot(points[u][0] - points[v][0], points[u][1] - points[v][1])
                if c < dist.get(v, math.inf):
                    dist[v] = c
                    heapq.heappush(heap, (c, v))
    return None


def test_against_brute_force():
    rng, met = random.Random(3), 0
    for _ in range(40):
        traps, gates = random_mesh(rng, 4)
        if len(traps) < 3:
            continue
        m, full = Mesh(traps, gates), Mesh(traps, gates, False)
        for _ in range(3):
            a, b = rng.choice(traps), rng.choice(traps)
            start, goal = ((a[6] + a[7]) / 2, a[3] + rng.choice([2.0, 5.0])), ((b[6] + b[7]) / 2 + 0.25, b[3] + 6.0)
            error, length, _ = m.route(start, 0, goal, 0)
            assert full.route(start, 0, goal, 0)[1] == pytest.approx(length) if error is None else full.route(start, 0, goal, 0)[0] == error
            expect = visibility_length(traps, gates, start, goal, m)
            if error is None:
                met += 1
                assert expect is not None and length == pytest.approx(expect, abs=1e-3)
            else:
                assert expect is None
    assert met > 8
