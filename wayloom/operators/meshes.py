"""Mesh generation over many maps: one kernel call per map, results as normalised tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAPEZOIDS = "map_id bigint, plane bigint, idx bigint, nb array<bigint>, y_top double, y_bottom double, x_top_left double, x_top_right double, x_bottom_left double, x_bottom_right double"


def generate(samples: DataFrame, starts: DataFrame, spacing: float, most: float = 0.5) -> DataFrame:
    """Trapezoids of each map's ground from height samples ``map_id, x, y, z`` and starts ``map_id, x, y``."""

    def kernel(grid: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        from wayloom.functions.meshgen import ground_mesh

        names = [c.split(" ")[0] for c in TRAPEZOIDS.split(", ")]
        if grid.empty or begin.empty:
            return pd.DataFrame(columns=names)
        z = grid.pivot(index="y", columns="x", values="z").to_numpy(float)
        traps = ground_mesh(z, spacing, sorted(zip(begin["x"].astype(float), begin["y"].astype(float), strict=True)), most=most)
        keys = names[4:]
        return pd.DataFrame([(int(grid["map_id"].iloc[0]), 0, k, t["nb"], *(t[c] for c in keys)) for k, t in enumerate(traps)], columns=names)

    return samples.groupBy("map_id").cogroup(starts.groupBy("map_id")).applyInPandas(kernel, TRAPEZOIDS)


def path_chunks(traps: DataFrame) -> DataFrame:
    """Each map's planes as the bytes of a path chunk's section: ``map_id, content``."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        from wayloom.functions import mapfile, meshgen

        rows = []
        for _, plane in pdf.sort_values(["plane", "idx"]).groupby("plane"):
            out = []
            for r in plane.itertuples(index=False):
                t = {c: getattr(r, c) for c in ("y_top", "y_bottom", "x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")}
                t["nb"] = [None if n is None or n != n else int(n) for n in r.nb]
                t["left"] = ((t["x_bottom_left"], t["y_bottom"]), (t["x_top_left"], t["y_top"]))
                t["right"] = ((t["x_bottom_right"], t["y_bottom"]), (t["x_top_right"], t["y_top"]))
                out.append(t)
            rows.append(meshgen.plane_record(out, []))
        return pd.DataFrame([(int(pdf["map_id"].iloc[0]), mapfile.write_planes(rows))], columns=["map_id", "content"])

    return traps.groupBy("map_id").applyInPandas(kernel, "map_id bigint, content binary")


def extents(maps: DataFrame, traps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n, x0, y0, x1, y1`` of every map: its trapezoids and the bounds of their finite corners; an empty one has +-1000."""
    real = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    xs, ys = [real(c) for c in ("x_top_left", "x_top_right", "x_bottom_left", "x_bottom_right")], [real(c) for c in ("y_top", "y_bottom")]
    sums = traps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.least(*xs)).alias("x0"), F.min(F.least(*ys)).alias("y0"), F.max(F.greatest(*xs)).alias("x1"), F.max(F.greatest(*ys)).alias("y1"))
    out = maps.select(*keys).distinct().join(sums, list(keys), "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("x0", -1000.0), ("y0", -1000.0), ("x1", 1000.0), ("y1", 1000.0))])


def invariants(traps: DataFrame) -> DataFrame:
    """Per map: trapezoids, their area, and how many break a rule (order of sides, neighbours that don't point back)."""
    area = (F.col("x_top_right") - F.col("x_top_left") + F.col("x_bottom_right") - F.col("x_bottom_left")) / 2 * (F.col("y_top") - F.col("y_bottom"))
    bad = (F.col("y_top") <= F.col("y_bottom")) | (F.col("x_top_left") > F.col("x_top_right") + 1e-9) | (F.col("x_bottom_left") > F.col("x_bottom_right") + 1e-9)
    return traps.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"), F.count_if(bad).alias("bad"))
