"""Clustering and classification of detections (beam, buffer, time, dm, snr)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.shared import components, counted_join, discard, materialize, merge_join, write_table

from .blocks import by_group


def near_pairs(points: DataFrame, eps: tuple[float, float, float], keys: list[str]) -> DataFrame:
    """Pairs of points of one group strictly within eps in time, dm and snr, each from either side.

    A band join: points go to cells of eps in time and dm, one side also to the
    eight cells around, and pairs that meet in a cell are tested. Callers keep
    sums over them, not pairs.
    """
    et, ed, es = eps
    cell = points.withColumn("ct", F.floor(F.col("time") / et)).withColumn("cd", F.floor(F.col("dm") / ed))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    wide = cell.withColumn("o", around).select(*keys, (F.col("ct") + F.col("o.a")).alias("ct"), (F.col("cd") + F.col("o.b")).alias("cd"), "id", "time", "dm", "snr")
    x, y = wide.alias("x"), cell.select(*keys, "ct", "cd", F.col("id").alias("id2"), F.col("time").alias("time2"), F.col("dm").alias("dm2"), F.col("snr").alias("snr2")).alias("y")
    near = (F.abs(F.col("time") - F.col("time2")) < et) & (F.abs(F.col("dm") - F.col("dm2")) < ed) & (F.abs(F.col("snr") - F.col("snr2")) < es)
    return x.join(y, [*keys, "ct", "cd"]).filter(near & (F.col("id") != F.col("id2")))


def neighbours(points: DataFrame, eps: tuple[float, float, float], keys: list[str]) -> DataFrame:
    """(id, n): how many other points of the same group lie strictly within eps in time, dm and snr."""
    found = near_pairs(points, eps, keys).groupBy("id").agg(F.count("*").alias("n"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def fuzzy_neighbours(points: DataFrame, eps: tuple[float, float, float], keys: list[str]) -> DataFrame:
    """(id, weight): sum of the memberships of a point's neighbours, which fall from 1 at the point to 0 at eps."""
    far = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}2")) / e for c, e in zip(("time", "dm", "snr"), eps)))
    found = near_pairs(points, eps, keys).groupBy("id").agg(F.sum(F.lit(1.0) - far).alias("weight"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def highest_potential(points: DataFrame, eps: tuple[float, float, float], keys: list[str]) -> DataFrame:
    """(keys, id, potential): the first centre of subtractive clustering in each group; of equals the least id.

    A point has potential 1, and exp(-4 d^2) from each neighbour within eps, d being their distance in eps.
    """
    square = sum(((F.col(c) - F.col(f"{c}2")) / e) * ((F.col(c) - F.col(f"{c}2")) / e) for c, e in zip(("time", "dm", "snr"), eps))
    near = near_pairs(points, eps, keys).groupBy("id").agg(F.sum(F.exp(-4.0 * square)).alias("near"))
    all_points = points.select(*keys, "id").join(near, "id", "left").withColumn("potential", F.round(1.0 + F.coalesce("near", F.lit(0.0)), 6))
    return all_points.groupBy(*keys).agg(F.max_by("id", F.struct("potential", -F.col("id"))).alias("id"), F.max("potential").alias("potential"))


def subtractive_centres(points: DataFrame, eps: tuple[float, float, float], keys: list[str], squash: float = 1.25, accept: float = 0.5, reject: float = 0.15) -> DataFrame:
    """(keys, id, potential, ratio): all centres of subtractive clustering of each group, with the potential each was chosen at.

    A point has potential 1, and exp(-4 d^2) from each neighbour within eps, d being their distance in eps. The point
    with the highest potential (of equals the least id) is looked at next: above ``accept`` of the group's first
    potential it is a centre; down to ``reject`` it is one if its share and its distance from the nearest centre, in
    eps, come to 1; else it goes. A centre of potential p takes p exp(-4 d^2 / squash^2) from the points within
    ``squash`` eps of it on each axis; below ``reject`` of the first potential the group is done.

    What happens to a point depends on points within ``squash`` eps only, and potentials never rise. So each round
    looks at all points, of all groups, that none within that range outranks: these are looked at in the order of
    potentials too, only together. Rounds grow with the longest chain of ever lower neighbours, not with the number
    of centres. Points below ``reject`` can't become centres, and are dropped as soon as they are. A round's tables go
    when the next one's are written.
    """
    spark = points.sparkSession
    wide = tuple(e * squash for e in eps)
    square = sum(((F.col(c) - F.col(f"{c}2")) / e) * ((F.col(c) - F.col(f"{c}2")) / e) for c, e in zip(("time", "dm", "snr"), eps))
    near = near_pairs(points, eps, keys).groupBy(*keys, "id").agg(F.sum(F.exp(-4.0 * square)).alias("near"))
    start = points.select(*keys, "id").join(near, [*keys, "id"], "left").select(*keys, "id", (1.0 + F.coalesce("near", F.lit(0.0))).alias("potential"))
    start = materialize(start, "potentials")
    first = start.groupBy(*keys).agg(F.max("potential").alias("first"))
    state = start.join(first, keys).withColumn("ratio", F.col("potential") / F.col("first")).filter(F.col("ratio") > reject)
    state, old = write_table(state.select(*keys, "id", "potential", "first", "ratio", F.lit(float("inf")).alias("away")), "centre-state")
    # pairs of points that may still become centres
    able = points.join(state.select(*keys, "id"), [*keys, "id"], "left_semi")
    pairs = materialize(near_pairs(able, wide, keys).select(*keys, "id", "id2", square.alias("d2")), "centre-pairs")
    found = []
    while not state.isEmpty():
        rank = F.struct("potential", (-F.col("id")).alias("i"))
        others = state.select(*keys, F.col("id").alias("id2"), rank.alias("other"))
        outranked = pairs.join(others, [*keys, "id2"]).groupBy(*keys, "id").agg(F.max("other").alias("best"))
        looked = state.join(outranked, [*keys, "id"], "left").withColumn("now", F.col("best").isNull() | (rank > F.col("best")))
        centre = F.col("now") & ((F.col("ratio") > accept) | (F.col("ratio") + F.col("away") >= 1.0))
        looked, path = write_table(looked.withColumn("centre", centre).drop("best"), "centre-looked")
        chosen = looked.filter("centre")
        found.append(write_table(chosen.select(*keys, "id", "potential", "ratio"), "centres"))
        taken = pairs.join(chosen.select(*keys, F.col("id").alias("id2"), F.col("potential").alias("p")), [*keys, "id2"])
        taken = taken.groupBy(*keys, "id").agg(F.sum(F.col("p") * F.exp(-4.0 * F.col("d2") / F.lit(squash * squash))).alias("less"), F.min(F.sqrt("d2")).alias("d"))
        left = looked.filter("not now").join(taken, [*keys, "id"], "left")
        left = left.withColumn("potential", F.col("potential") - F.coalesce("less", F.lit(0.0))).withColumn("ratio", F.col("potential") / F.col("first")).withColumn("away", F.least("away", F.coalesce("d", F.lit(float("inf")))))
        before = old
        state, old = write_table(left.filter(F.col("ratio") > reject).select(*state.columns), "centre-state")
        discard(spark, before, path)
    discard(spark, old)
    if not found:
        return start.select(*keys, "id", "potential", F.lit(1.0).alias("ratio")).limit(0)
    # a small table for each round
    out = materialize(reduce(DataFrame.unionByName, (f for f, _ in found)), "all-centres")
    discard(spark, *(p for _, p in found))
    return out


def unrelated(points: DataFrame, span: float, keys: list[str]) -> DataFrame:
    """Points (keys, id, time, snr) that no better one of their group lies within ``span`` of in time: of a higher snr, or of the same and a lesser id.

    In a stretch of ``span`` only the best point can stay, and only points of the two stretches beside it may still be
    better. So one row a stretch meets the points again, and work grows with their number, however densely they lie.
    A point without a group, time or snr has no better one.
    """
    columns = points.columns
    whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, "time", "snr")))
    placed = points.filter(whole).withColumn("_stretch", F.floor(F.col("time") / span))
    stretch = [*keys, "_stretch"]

    def better(snr: str, ident: str) -> Column:
        """Whether the row with these columns is better than the one with ``snr`` and ``id``; unknown ids decide nothing."""
        return F.coalesce((F.col(snr) > F.col("snr")) | ((F.col(snr) == F.col("snr")) & (F.col(ident) < F.col("id"))), F.lit(False))

    best = placed.groupBy(*stretch).agg(F.max(F.struct("snr", (-F.col("id")).alias("i"))).alias("_best"))
    best = materialize(best.select(*stretch, F.col("_best.snr").alias("snr2"), (-F.col("_best.i")).alias("id2")), "best")
    rows = best.count()
    stay = materialize(counted_join(placed, best, stretch, rows).filter(~better("snr2", "id2")).select(*columns, "_stretch"), "best-of-stretch")
    beside = stay.withColumn("_stretch", F.explode(F.array(F.col("_stretch") - 1, F.col("_stretch") + 1))).select(*stretch, "id", "time", "snr")
    others = placed.select(*stretch, F.col("id").alias("id2"), F.col("time").alias("time2"), F.col("snr").alias("snr2"))
    beaten = counted_join(others, beside, stretch, 2 * rows).filter((F.abs(F.col("time") - F.col("time2")) <= span) & better("snr2", "id2"))
    beaten = beaten.select(*keys, *(F.col(c).alias(f"{c}2") for c in ("id", "time", "snr"))).distinct()
    same = reduce(Column.__and__, (stay[c].eqNullSafe(beaten[c if c in keys else f"{c}2"]) for c in (*keys, "id", "time", "snr")))
    return stay.join(beaten, same, "left_anti").select(*columns).unionByName(points.filter(~whole))


def core_clusters(points: DataFrame, eps: tuple[float, float, float], least: int, keys: list[str]) -> DataFrame:
    """Density clusters of each (beam, buffer): columns cluster (0.. by first point, -1 noise) and type (1 core, 0 border, -1 noise).

    Core points with a chain of core neighbours form a cluster; a border point joins its first core neighbour's. No
    task holds a group, and dense places need no pairs of points: points whose half cells of eps (in time, dm and snr)
    are the same or touch are neighbours for certain. So a point is core where its half cell and the 26 around it hold
    enough points, and touching half cells with core points are joined as wholes. Only points that this leaves open are
    counted by pairs, and pairs two half cells apart are tested only between clusters that are still apart. All its
    tables grow with the points, so none of its joins is a broadcast.
    """
    columns = points.columns
    place = ("time", "dm", "id")
    ident = F.struct(*keys, "id")
    cell = points.withColumn("_p", ident)
    for c, e in zip(("time", "dm"), eps):
        cell = cell.withColumn(f"_{c}", F.floor(F.col(c) / e))
    cell = cell.select("*", *(F.floor(F.col(c) * 2 / e).alias(f"_h{c}") for c, e in zip(("time", "dm", "snr"), eps)))
    cells = [*keys, "_time", "_dm"]
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))

    def meeting(left: DataFrame, right: DataFrame, carried: list[str]) -> DataFrame:
        """Pairs of neighbours; the right one's columns end in 2."""
        wide = left.select(*keys, "_p", "time", "dm", "snr", "_time", "_dm", around.alias("_o"))
        wide = wide.withColumn("_time", F.col("_time") + F.col("_o.a")).withColumn("_dm", F.col("_dm") + F.col("_o.b")).drop("_o")
        others = right.select(*keys, "_time", "_dm", *(F.col(c).alias(f"{c}2") for c in [*carried, "_p", "id", "time", "dm", "snr"]))
        near = F.lit(True)
        for c, e in zip(("time", "dm", "snr"), eps):
            near &= F.abs(F.col(c) - F.col(f"{c}2")) < e
        return merge_join(wide, others, cells).filter(near & (F.col("_p") != F.col("_p2")))

    halves = ["_htime", "_hdm", "_hsnr"]
    nodes = [*keys, *halves]

    def offsets(far: int, least_far: int = 0):
        """Steps of up to ``far`` half cells each way, of which the longest is ``least_far`` at least."""
        steps = [o for o in product(range(-far, far + 1), repeat=3) if max(map(abs, o)) >= least_far]
        return steps, F.explode(F.array(*(F.struct(*(F.lit(v).alias(h) for h, v in zip(halves, o))) for o in steps)))

    def moved(rows: DataFrame, steps) -> DataFrame:
        return rows.withColumn("_o", steps).withColumns({h: F.col(h) + F.col(f"_o.{h}") for h in halves}).drop("_o")

    per_half = cell.groupBy(*nodes).agg(F.count("*").alias("_n"))
    around_half = moved(per_half, offsets(1)[1]).groupBy(*nodes).agg(F.sum("_n").alias("_near"))
    cell = materialize(merge_join(cell, around_half, nodes).withColumn("_sure", F.col("_near") > least).drop("_near"), "points")
    # a point needs itself only where no neighbour is asked for
    open_points = cell.filter("not _sure").drop("_sure")
    crowd = meeting(open_points, cell, []).groupBy("_p").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    crowd = materialize(crowd.select("_p"), "crowded")
    core = cell.filter("_sure").drop("_sure").unionByName(merge_join(open_points, crowd, "_p", "left_semi"))
    rest = merge_join(open_points, crowd, "_p", "left_anti")
    core = materialize(merge_join(core, core.groupBy(*nodes).agg(F.min("_p").alias("_node")), nodes), "core-points")
    half = materialize(core.groupBy(*nodes).agg(F.first("_node").alias("_node")), "core-cells")

    def side(steps: list) -> list:
        return [o for o in steps if o > (0, 0, 0)]

    def cell_pairs(far: int, least_far: int, of: DataFrame, carried: list[str]) -> DataFrame:
        """Pairs of half cells so far apart, each once; the second one's columns end in 2."""
        steps = side(offsets(far, least_far)[0])
        away = F.explode(F.array(*(F.struct(*(F.lit(v).alias(h) for h, v in zip(halves, o))) for o in steps)))
        return merge_join(moved(of, away), of.select(*nodes, *(F.col(c).alias(f"{c}2") for c in carried)), nodes).select(*carried, *(f"{c}2" for c in carried))

    touching = cell_pairs(1, 1, half, ["_node"]).select(F.col("_node").alias("a"), F.col("_node2").alias("b"))
    joined = components(touching).select(F.col("node").alias("_node"), F.col("root").alias("_part"))
    half = materialize(merge_join(half, joined, "_node", "left").withColumn("_part", F.coalesce("_part", "_node")), "core-cells")
    apart = cell_pairs(2, 2, half, ["_node", "_part"]).filter("_part <> _part2")
    one = core.select("_node", "time", "dm", "snr")
    two = core.select(F.col("_node").alias("_node2"), F.col("time").alias("time2"), F.col("dm").alias("dm2"), F.col("snr").alias("snr2"))
    near = F.lit(True)
    for c, e in zip(("time", "dm", "snr"), eps):
        near &= F.abs(F.col(c) - F.col(f"{c}2")) < e
    edges = merge_join(merge_join(apart, one, "_node"), two, "_node2").filter(near).select(F.col("_part").alias("a"), F.col("_part2").alias("b"))
    joined = components(edges).select(F.col("node").alias("_part"), "root")
    root = merge_join(half, joined, "_part", "left").select("_node", F.coalesce("root", "_part").alias("root"))
    core = merge_join(core, root, "_node")
    # clusters by their first point; a row for each cluster, not for each point
    first = core.groupBy(*keys, "root").agg(F.min(F.struct(*place)).alias("first"))
    numbers = first.select("root", (F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).alias("cluster"))
    needed = [c for c in ("_p", *keys, "id", "time", "dm", "snr", "_time", "_dm") if c not in columns]
    core = materialize(merge_join(core, numbers, "root").select(*columns, *needed, "cluster"), "clustered")
    reached = meeting(rest, core, ["cluster"]).groupBy("_p").agg(F.min_by("cluster2", F.struct("time2", "dm2", "id2")).alias("_border"))
    border = merge_join(rest, reached, "_p", "left").select(*columns, F.coalesce("_border", F.lit(-1)).cast("int").alias("cluster"), F.when(F.col("_border").isNull(), -1).otherwise(0).alias("type"))
    return core.select(*columns, F.col("cluster").cast("int").alias("cluster"), F.lit(1).alias("type")).unionByName(border)


def dm_histogram(points: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, bin, weight): summed snr by rounded dm."""
    return points.groupBy(*keys, F.floor(F.col("dm") / step + 0.5).cast("int").alias("bin")).agg(F.sum("snr").alias("weight"))


def smooth_histogram(hist: DataFrame, keys: list[str], last: int | None = None) -> DataFrame:
    """(keys, bin, smooth): three-bin means, empty bins as zero, of every bin that a weight reaches; nothing is left out.

    The first bin, 0, stays as it is, and so does ``last``, where trials end there. Without it bins have no end.
    """
    ends = F.col("bin").isin([0] if last is None else [0, last])
    raw = F.col("to").isin([0] if last is None else [0, last])
    outside = (F.col("bin") == 0) & (F.col("to") < 0)
    if last is not None:
        outside |= (F.col("bin") == last) & (F.col("to") > last)
    spread = hist.withColumn("to", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    spread = spread.filter(~(ends & outside) & (~raw | (F.col("to") == F.col("bin"))))
    # an end bin without weight of its own is not there
    return spread.groupBy(*keys, F.col("to").alias("bin")).agg(F.sum(F.when(raw, F.col("weight")).otherwise(F.col("weight") / 3.0)).alias("smooth"))


def cluster_params(points: DataFrame, keys: list[str], step: float, last: int | None = None) -> DataFrame:
    """(keys, n, max_dm, level, max_snr, start, width, position) of each cluster.

    ``max_dm`` is the median of the histogram's bins above nine tenths of its peak, and ``level`` their mean. The
    best snr is that within half a step of it; ``width`` is 0.4 of the time, in milliseconds, that points within a
    step of it span, and ``position`` their middle.
    """
    smooth = smooth_histogram(dm_histogram(points, keys, step), keys, last)
    top = smooth.groupBy(*keys).agg(F.max("smooth").alias("top"))
    high = merge_join(smooth, top, keys).filter(F.col("smooth") > 0.9 * F.col("top"))
    peak = high.groupBy(*keys).agg((F.median("bin") * step).alias("max_dm"), F.avg("smooth").alias("level"))
    near = merge_join(points, peak, keys)
    off = F.abs(F.col("dm") - F.col("max_dm"))
    first, last = F.min(F.when(off < step, F.col("time"))), F.max(F.when(off < step, F.col("time")))
    return near.groupBy(*keys, "max_dm", "level").agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.when(off < step * 0.5, F.col("snr"))), F.lit(0.0)).alias("max_snr"),
        F.min("time").alias("start"),
        ((last - first) * 400.0).alias("width"),
        (first + (last - first) / 2.0).alias("position"),
    )


def model_curve(y: Column) -> Column:
    """Relative snr of a pulse dedispersed off its measure: sqrt(pi) / 2 * erf(y) / y, for y of any sign.

    exp(-y^2) times the sum of (2 y^2)^n / (1 * 3 * .. * (2n + 1)), whose terms are all positive; beyond y = 6 the
    error function is 1 to fifteen digits.
    """
    square = y * y

    def add(state, n):
        term = state["term"] * 2.0 * square / (2.0 * n + 1.0)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), add, lambda s: s["total"])
    return F.when(F.abs(y) < 6.0, F.exp(-square) * series).otherwise(F.sqrt(F.pi()) * 0.5 / F.abs(y))


def classify(points: DataFrame, keys: list[str], step: float, band_mhz: float, top_mhz: float, least_width: float = 0.0, last: int | None = None) -> DataFrame:
    """``cluster_params`` with ``mse``, the mean squared distance of the snr curve from a pulse's, and ``pulse``.

    Clusters at a dm of 2 or less, or without a width above ``least_width``, are interference and have mse 1; of the
    others those below 0.1 are pulses. The curve is compared over the trials 0 to ``last``, or, without it, over the
    bins that the cluster reaches.
    """
    params = cluster_params(points, keys, step, last)
    hist = dm_histogram(points, keys, step)
    smooth = smooth_histogram(hist, keys, last)
    low, high = F.min("bin"), F.max("bin")
    reach = hist.groupBy(*keys).agg(F.when(low == 0, 0).otherwise(low - 1).alias("from_bin"), F.when(high == F.lit(last), high).otherwise(high + 1).alias("to_bin"))
    if last is not None:
        reach = reach.withColumns({"from_bin": F.least(F.lit(0), "from_bin"), "to_bin": F.greatest(F.lit(last), "to_bin")})
    fair = (F.col("max_dm") > 2.0) & (F.col("width") > least_width)
    freq = (top_mhz * 1e-3 - band_mhz * 1e-3 * 0.5) ** 3
    grid = merge_join(params.filter(fair), reach, keys).select(*keys, "max_dm", "level", "width", F.explode(F.sequence("from_bin", "to_bin")).alias("bin"))
    y = F.lit(6.91e-3) * (F.col("bin") * step - F.col("max_dm")) * (band_mhz / (F.col("width") * freq))
    model = F.when(F.col("bin") == F.floor(F.col("max_dm") / step + 0.5), 1.0).otherwise(model_curve(y))
    miss = F.coalesce(F.col("smooth"), F.lit(0.0)) / F.col("level") - model
    mse = merge_join(grid, smooth, [*keys, "bin"], "left").groupBy(*keys).agg(F.avg(miss * miss).alias("mse"))
    out = merge_join(params, mse, keys, "left").withColumn("mse", F.coalesce("mse", F.lit(1.0)))
    return out.withColumn("pulse", F.col("mse") < 0.1)


def scan_clusters(points: DataFrame, eps: tuple[float, float, float], least: int, keys: list[str], fast: bool = False) -> DataFrame:
    """The order-dependent clustering of a buffer: columns cluster (1.. in scan order, -1 noise) and type 0.

    Points are scanned by dm, time and id. A point that no cluster has yet and that has ``least`` unvisited neighbours
    starts one, which takes all unvisited points that chains of neighbours reach, however few each has; a point that
    was visited as noise stays noise. With ``fast``, all of a point's neighbours count and join, only six extreme ones
    are followed, those that have ``least`` neighbours, and noise may join later.

    A buffer's points lie in one task, as their order decides; that is bounded by a buffer's samples and trials.
    ``core_clusters`` has no such group.
    """
    at = points.columns
    ready = points.select(*keys, "id", "time", "dm", "snr")

    def of_group(key: tuple, columns: dict) -> Iterator[dict]:
        order = np.lexsort((columns["id"], columns["time"], columns["dm"]))
        label = (extremes if fast else chains)(*(columns[c][order] for c in ("time", "dm", "snr")), eps, least)
        yield {**{k: np.full(len(order), v) for k, v in zip(keys, key)}, "id": columns["id"][order], "cluster": label}

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in [*keys, "id"])
    labels = by_group(ready, keys, of_group, f"{kinds}, cluster int")
    return points.join(labels, [*keys, "id"]).select(*at, "cluster", F.lit(0).alias("type"))


class Cells:
    """The points of a buffer by cells of eps, for neighbour searches."""

    def __init__(self, time: np.ndarray, dm: np.ndarray, snr: np.ndarray, eps: tuple[float, float, float]):
        self.axes, self.eps = (time, dm, snr), eps
        self.cell = list(zip(*(np.floor(a / e).astype(np.int64).tolist() for a, e in zip((time, dm), eps))))
        self.of: dict[tuple[int, int], list[int]] = {}
        for i, c in enumerate(self.cell):
            self.of.setdefault(c, []).append(i)
        self.members = {c: np.array(m) for c, m in self.of.items()}

    def near(self, i: int) -> np.ndarray:
        """Points strictly within eps of ``i``, without itself, in order."""
        t, d = self.cell[i]
        around = [self.members[c] for a in (-1, 0, 1) for b in (-1, 0, 1) if (c := (t + a, d + b)) in self.members]
        j = np.concatenate(around)
        keep = j != i
        for axis, e in zip(self.axes, self.eps):
            keep &= np.abs(axis[j] - axis[i]) < e
        return np.sort(j[keep])


def chains(time: np.ndarray, dm: np.ndarray, snr: np.ndarray, eps: tuple[float, float, float], least: int) -> np.ndarray:
    cells, label, found = Cells(time, dm, snr, eps), np.zeros(len(time), np.int32), 0
    for i in range(len(time)):
        if label[i]:
            continue
        near = cells.near(i)
        near = near[label[near] == 0]
        if len(near) < least:
            label[i] = -1
            continue
        found += 1
        label[i] = label[near] = found
        todo = near.tolist()
        while todo:
            near = cells.near(todo.pop())
            near = near[label[near] == 0]
            label[near] = found
            todo += near.tolist()
    return label


def extremes(time: np.ndarray, dm: np.ndarray, snr: np.ndarray, eps: tuple[float, float, float], least: int) -> np.ndarray:
    cells, label, found = Cells(time, dm, snr, eps), np.zeros(len(time), np.int32), 0

    def ends(near: np.ndarray) -> list[int]:
        # of equals the last one
        last = near[::-1]
        return [int(last[f(axis[last])]) for axis in (time, dm, snr) for f in (np.argmin, np.argmax)]

    for i in range(len(time)):
        if label[i] > 0:
            continue
        near = cells.near(i)
        if len(near) < least:
            label[i] = -1
            continue
        found += 1
        label[i] = label[near] = found
        todo = deque(ends(near))
        while todo:
            near = cells.near(todo.popleft())
            if len(near) >= least:
                todo.extend(j for j in ends(near) if label[j] == 0)
            label[near[label[near] <= 0]] = found
    return label
