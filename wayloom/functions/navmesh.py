"""The path-search kernel of one map's mesh: exact shortest paths by a search over intervals of gates.

A search state is a root (the last bend) and an interval of a gate that is visible from it. Expanding one across a convex
trapezoid gives, for each other gate, the part seen through the interval and, where an interval's end is a bend, the
parts beside it with that end as new root. States come by root cost plus straight distance to the goal, so the first
state that reaches the goal is on a shortest path. No state is made for a root that was reached at less cost.
"""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np

TOL, EPS, ROW = 0.02, 1e-9, 16.0
START_OFF, GOAL_OFF, UNREACHABLE = "StartOffMesh", "GoalOffMesh", "Unreachable"


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _dist(a, b):
    return math.hypot(a[0] - b[0], a[1] - b[1])


def _near(p, a, b):
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = 0.0 if n == 0 else min(1.0, max(0.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n))
    return math.hypot(p[0] - a[0] - (b[0] - a[0]) * t, p[1] - a[1] - (b[1] - a[1]) * t)


class Mesh:
    """Trapezoids as rows (plane, idx, y_top, y_bottom, x_top_left, x_top_right, x_bottom_left, x_bottom_right).

    Gates are rows (plane, idx, to_plane, dst, edge, ax, ay, bx, by).
    """

    def __init__(self, traps, gates, prune: bool = True):
        self.traps = sorted(map(tuple, traps))
        self.at = {t[:2]: i for i, t in enumerate(self.traps)}
        self.gates: list[list] = [[] for _ in self.traps]
        for plane, idx, to_plane, dst, edge, ax, ay, bx, by in gates:
            to = self.at.get((to_plane, dst))
            if to is not None and (plane, idx) in self.at:
                self.gates[self.at[plane, idx]].append(((ax, ay), (bx, by), to, edge))
        self.planes = sorted({t[0] for t in self.traps}, reverse=True)
        self.rows: dict = {}  # trapezoids by plane and stripe of heights, in order
        for i, t in enumerate(self.traps):
            for row in range(math.floor((t[3] - TOL) / ROW), math.floor((t[2] + TOL) / ROW) + 1):
                self.rows.setdefault((t[0], row), []).append(i)
        self.bends = self._bends() if prune else None

    def _vertices(self, t):
        out = []
        for v in ((t[6], t[3]), (t[7], t[3]), (t[5], t[2]), (t[4], t[2])):
            if not out or v != out[-1]:
                out.append(v)
        return out[:-1] if len(out) > 1 and out[0] == out[-1] else out

    def _bends(self):
        """Points with more than half a turn of walkable ground around them, or by a portal."""
        angle: dict = {}
        for i, t in enumerate(self.traps):
            v = self._vertices(t)
            flat = t[2] <= t[3] or len(v) < 3
            for k, p in enumerate(v):
                a, b = v[k - 1], v[(k + 1) % len(v)]
                turn = math.pi if flat else math.atan2(abs(_cross(p, a, b)), (a[0] - p[0]) * (b[0] - p[0]) + (a[1] - p[1]) * (b[1] - p[1]))
                angle[t[0], p] = angle.get((t[0], p), 0.0) + turn
            for a, b, _, _ in self.gates[i]:
                for p in (a, b):
                    if p not in v:
                        angle[t[0], p] = angle.get((t[0], p), 0.0) + math.pi
        out = {p for (_, p), s in angle.items() if s > math.pi + 1e-6}
        return out | {p for g in self.gates for a, b, _, e in g if e in ("left", "right") for p in (a, b)}

    def holds(self, i: int, p, tol: float) -> bool:
        _, _, top, bottom, tl, tr, bl, br = self.traps[i]
        if not bottom - tol <= p[1] <= top + tol:
            return False
        y = min(top, max(bottom, p[1]))
        f = (y - bottom) / (top - bottom) if top > bottom else 0.0
        return bl + (tl - bl) * f - tol <= p[0] <= br + (tr - br) * f + tol

    def locate(self, p, plane) -> int | None:
        row = math.floor(p[1] / ROW)
        for k in [plane, *(k for k in self.planes if k != plane)]:
            for tol in (0.0, TOL):
                hit = next((i for i in self.rows.get((k, row), ()) if self.holds(i, p, tol)), None)
                if hit is not None:
                    return hit
        return None

    def incident(self, p, seed: int) -> list[int]:
        """The trapezoids around a point: those that gates through it lead to."""
        found = [seed]
        for i in found:
            found += [g[2] for g in self.gates[i] if g[2] not in found and _near(p, g[0], g[1]) <= TOL]
        return list(dict.fromkeys(found))

    def route(self, start, start_plane, goal, goal_plane):
        """``(error, None, None)`` or ``(None, length, [(x, y, plane), ...])``."""
        s = self.locate(start, start_plane)
        if s is None:
            return START_OFF, None, None
        g = self.locate(goal, goal_plane)
        if g is None:
            return GOAL_OFF, None, None
        goals = set(self.incident(goal, g))
        near = self.incident(start, s)
        if goals & set(near):
            return None, _dist(start, goal), [(*start, start_plane), (*goal, goal_plane)]
        serial, heap = count(), []
        best = {start: 0.0}
        parent: dict = {start: None}
        plane_of = {start: start_plane}

        def push(root, cost, right, left, trap, back):
            heapq.heappush(heap, (cost + _dist(root, goal), next(serial), root, cost, right, left, trap, back))

        def bend(end, root, cost, trap):
            """Cost at ``end`` if a path may bend there and none is known that is shorter."""
            further = cost + _dist(root, end)
            if end != root and self.bends is not None and end not in self.bends or further > best.get(end, math.inf) + EPS:
                return None
            if further < best.get(end, math.inf):
                best[end], parent[end], plane_of[end] = further, root, self.traps[trap][0]
            return further

        def along(root, cost, a, b, to, trap):
            """Into a gate that lies on one line with the root: around its nearer end."""
            end = min((a, b), key=lambda e: _dist(root, e))
            further = bend(end, root, cost, trap)
            if further is not None:
                push(end, further, a, b, to, trap)

        flat = lambda o, a, b: abs(_cross(o, a, b)) <= EPS * max(1.0, _dist(a, b))
        for t in near:
            for a, b, to, _ in self.gates[t]:
                if to not in near and flat(start, a, b):
                    along(start, 0.0, a, b, to, t)
                elif to not in near:
                    right, left = (a, b) if _cross(start, a, b) >= 0 else (b, a)
                    push(start, 0.0, right, left, to, t)
        final = None
        while heap:
            f, _, root, cost, right, left, trap, back = heapq.heappop(heap)
            if trap is None:  # the goal itself, from root
                final = (root, cost)
                break
            if cost > best.get(root, math.inf) + EPS:
                continue
            if trap in goals:
                self._to_goal(heap, serial, root, cost, right, left, goal, bend, trap)
            inside = min(_dist(root, right), _dist(root, left)) <= EPS or flat(root, right, left)
            mid = ((right[0] + left[0]) / 2, (right[1] + left[1]) / 2)
            for a, b, to, _ in self.gates[trap]:
                if to == back:
                    continue
                if flat(root, a, b):
                    end = min((a, b), key=lambda e: _dist(root, e))
                    if inside or (_cross(root, right, end) >= -EPS and _cross(root, left, end) <= EPS):
                        along(root, cost, a, b, to, trap)
                    if inside:
                        continue
                if flat(mid, a, b):  # on the same side of the trapezoid
                    for end in (right, left):
                        further = bend(end, root, cost, trap)
                        if further is not None:
                            along(end, further, a, b, to, trap)
                    continue
                p, q = (a, b) if _cross(mid, a, b) > 0 else (b, a)
                lo, hi = (0.0, 1.0) if inside else (self._clip(root, right, p, q, True), self._clip(root, left, p, q, False))
                at = lambda t, p=p, q=q: p if t <= 0 else q if t >= 1 else (p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t)
                if hi - lo > EPS:
                    push(root, cost, at(lo), at(hi), to, trap)
                for end, span in ((right, (0.0, min(lo, 1.0))), (left, (max(hi, 0.0), 1.0))):
                    if span[1] - span[0] > EPS and not inside:
                        further = bend(end, root, cost, trap)
                        if further is not None and flat(end, a, b):
                            along(end, further, a, b, to, trap)
                        elif further is not None:
                            push(end, further, at(span[0]), at(span[1]), to, trap)
        if final is None:
            return UNREACHABLE, None, None
        nodes, at = [goal], final[0]
        while at is not None:
            nodes.append(at)
            at = parent[at]
        nodes.reverse()
        k = 1
        while k + 1 < len(nodes):
            span = _dist(nodes[k - 1], nodes[k + 1])
            if span and abs(_cross(nodes[k - 1], nodes[k + 1], nodes[k])) / span < TOL:
                del nodes[k]
            else:
                k += 1
        planes = [start_plane, *(plane_of[n] for n in nodes[1:-1]), goal_plane]
        return None, final[1] + _dist(final[0], goal), [(*n, pl) for n, pl in zip(nodes, planes, strict=True)]

    @staticmethod
    def _clip(root, end, p, q, right: bool) -> float:
        """Where the ray root-end meets p..q (0 to 1): the start (right) or end (left) of what is seen; beyond: all or none."""
        sp, sq = _cross(root, end, p), _cross(root, end, q)
        if right:
            return 0.0 if sp >= -EPS else 1.0 if sq <= EPS else sp / (sp - sq)
        return 1.0 if sq <= EPS else 0.0 if sp >= -EPS else sp / (sp - sq)

    def _to_goal(self, heap, serial, root, cost, right, left, goal, bend, trap):
        flat = abs(_cross(root, right, left)) <= EPS * max(1.0, _dist(right, left))
        seen = flat or (_cross(root, right, goal) >= -EPS and _cross(root, left, goal) <= EPS)
        for end in [root] if seen else [right, left]:
            further = cost if end == root else bend(end, root, cost, trap)
            if further is not None:
                heapq.heappush(heap, (further + _dist(end, goal), next(serial), end, further, None, None, None, None))


def route_requests(mesh, requests, prune: bool = True):
    """All routes of one map, pandas in and out: the function of a cogroup."""
    import pandas as pd

    key = [*("y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")]
    traps = mesh[mesh["kind"] == "trap"]
    gates = mesh[mesh["kind"] == "gate"]
    m = Mesh(traps[["plane", "idx", *key]].itertuples(index=False, name=None), gates[["plane", "idx", "to_plane", "dst", "edge", "ax", "ay", "bx", "by"]].itertuples(index=False, name=None), prune)
    out = []
    for r in requests.itertuples(index=False):
        error, length, points = m.route((float(r.from_x), float(r.from_y)), int(r.from_plane), (float(r.to_x), float(r.to_y)), int(r.to_plane))
        out.append((int(r.map_id), int(r.request_id), error, length, [{"x": float(x), "y": float(y), "plane": int(p)} for x, y, p in points] if points else None))
    return pd.DataFrame(out, columns=["map_id", "request_id", "error", "length", "points"]).astype({"length": np.float64})
