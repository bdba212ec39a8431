"""Holes, surfaces and distances on voxel grids.

Work follows surfaces and runs, not volumes: neighbours are compared along lines (at most
one axis long), and distances spread outwards from surface voxels only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.columns import AXES, VOXEL
from voxmill.operators import lines
from voxmill.operators.spread import attach, bounded, percentiles_of_counts, value_counts
from voxmill.session import settle

DISTANCE_LIMIT = 10.0  # fixed value: signed distances are clipped to +-10


def _by_slab(table: DataFrame) -> list[tuple[str, DataFrame]]:
    """The table for work along each axis. Slabs of constant i hold the lines of both other
    axes, so two of the three share one exchange."""
    slabs = table.repartition("case_id", "i")
    return [("k", slabs), ("j", slabs), ("i", table.repartition("case_id", "j"))]


def _line(axis: str, extra: tuple[str, ...] = ()) -> Window:
    return Window.partitionBy("case_id", *extra, *[a for a in AXES if a != axis]).orderBy(axis)


# --- holes ---------------------------------------------------------------------------

def _background_runs(mask: DataFrame, cases: DataFrame) -> DataFrame:
    """Maximal runs of background along k: (case_id, i, j, start, stop, run, border)."""
    empty = mask.filter(~F.col("inside")).select(*VOXEL)
    island = F.col("k") - F.row_number().over(_line("k"))
    runs = (empty.withColumn("_island", island).groupBy("case_id", "i", "j", "_island")
            .agg(F.min("k").alias("start"), F.max("k").alias("stop")).drop("_island"))
    shape = cases.select("case_id", *[F.col("shape")[a].alias(f"_n{a}") for a in range(3)])
    edge = (F.col("i") == 0) | (F.col("i") == F.col("_n0") - 1) | (F.col("j") == 0) | (F.col("j") == F.col("_n1") - 1) \
        | (F.col("start") == 0) | (F.col("stop") == F.col("_n2") - 1)
    # position in the volume, so that a run has one number within its case
    run = (F.col("i").cast("bigint") * F.col("_n1") + F.col("j")) * F.col("_n2") + F.col("start")
    return attach(runs, shape, ["case_id"]).select("case_id", "i", "j", "start", "stop", run.alias("run"), edge.alias("border"))


def _run_edges(runs: DataFrame) -> DataFrame:
    """Pairs of touching runs in neighbouring lines, both ways: (case_id, a, b)."""
    one_way, held = None, bounded(runs)
    for axis in ("i", "j"):
        here = runs.select("case_id", "i", "j", F.col("start").alias("s1"), F.col("stop").alias("e1"), F.col("run").alias("a"))
        there = held.select("case_id", *[(F.col(x) - 1 if x == axis else F.col(x)).alias(x) for x in ("i", "j")],
                            F.col("start").alias("s2"), F.col("stop").alias("e2"), F.col("run").alias("b"))
        found = here.join(there, ["case_id", "i", "j"]).filter("s1 <= e2 AND s2 <= e1").select("case_id", "a", "b")
        one_way = found if one_way is None else one_way.unionByName(found)
    return one_way.unionByName(one_way.select("case_id", F.col("b").alias("a"), F.col("a").alias("b")))


def connected_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node number of each connected component: (case_id, run, comp).

    A label is the number of a node. In every round a node takes the smallest label among
    its neighbours, the node it was labelled with takes the smallest that any of its
    followers found, and then all labels are replaced by the label of the node they name.
    The last step doubles the distance covered, so the rounds grow with the logarithm of
    the longest path; labels only fall, so they settle. Each round is written to the shared folder. There are as many
    names as nodes, so names are not repeated for salts; adaptive execution splits a component that is most of a case.
    Nodes, edges and labels are as many as voxels, so beyond a bounded number of rows none of them is broadcast.
    """
    labels, edges = settle(nodes.select("case_id", "run", F.col("run").alias("comp"))), bounded(edges)
    rows = labels.count()
    while True:
        around = edges.join(bounded(labels, rows).select("case_id", F.col("run").alias("b"), F.col("comp").alias("_nb")), ["case_id", "b"]) \
            .groupBy("case_id", F.col("a").alias("run")).agg(F.min("_nb").alias("_nb"))
        lower = labels.join(around, ["case_id", "run"], "left").withColumn("_low", F.least("comp", F.coalesce("_nb", "comp")))
        found = lower.groupBy("case_id", "comp").agg(F.min("_low").alias("_found")).withColumnRenamed("comp", "run")
        hooked = settle(lower.join(found, ["case_id", "run"], "left").select(
            "case_id", "run", "comp", F.least("_low", F.coalesce("_found", "_low")).alias("_low")))
        named = bounded(hooked, rows).select("case_id", F.col("run").alias("_low"), F.col("_low").alias("_next"))
        jumped = settle(hooked.join(named, ["case_id", "_low"]).select("case_id", "run", "comp", "_next"))
        labels = jumped.select("case_id", "run", F.col("_next").alias("comp"))
        rows, moved = jumped.agg(F.count(F.lit(1)), F.count_if(F.col("_next") != F.col("comp"))).first()
        if not moved:
            return labels


def fill_holes(mask: DataFrame, cases: DataFrame) -> DataFrame:
    """Background that no path of face neighbours connects to the border becomes inside."""
    runs = settle(_background_runs(mask, cases))
    labels = connected_labels(runs.select("case_id", "run"), settle(_run_edges(runs)))
    placed = runs.join(bounded(labels), ["case_id", "run"])
    open_comp = placed.groupBy("case_id", "comp").agg(F.max("border").alias("_open")).filter("NOT _open")
    holes = attach(placed, open_comp, ["case_id", "comp"]).select(
        "case_id", "i", "j", F.explode(F.sequence("start", "stop")).alias("k"), F.lit(True).alias("_hole"))
    return mask.join(holes, list(VOXEL), "left").select(
        *VOXEL, (F.col("inside") | F.coalesce("_hole", F.lit(False))).alias("inside"))


# --- bounded signed distance -----------------------------------------------------------

def _label_edges(segs: DataFrame) -> DataFrame:
    """Face neighbours with different labels: (voxel, own label, other label)."""
    out = None
    for axis, table in _by_slab(segs.select(*VOXEL, "label")):
        before = F.lag("label").over(_line(axis))
        changed = table.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col("label")))
        # one change of label is seen once and gives both voxels

        def side(shift: int, own: str, other: str) -> Column:
            return F.struct(*[(F.col(a) - shift if a == axis else F.col(a)).alias(a) for a in AXES],
                            F.col(own).alias("label"), F.col(other).alias("other"))

        found = changed.select("case_id", F.inline(F.array(side(0, "label", "_before"), side(1, "_before", "label"))))
        out = found if out is None else out.unionByName(found)
    return out


def _fill_pass(df: DataFrame, group: list[str], axis: str, low: str | None, high: str, step: str,
               limit: float | None = None, exchange: list[str] | None = None) -> DataFrame:
    """Squared distances d2 along one axis: each line's lower envelope at all places from ``low`` (0) to ``high``,
    or where it is within the limit. The other columns are those of the line."""
    keys = [*group, *[x for x in AXES if x != axis]]
    rest = [c for c in df.columns if c not in (axis, "d2")]

    def work(table: pa.Table, first: np.ndarray) -> pa.Table:
        # a place that is there twice counts once, with its smaller value, which comes first
        place, start = lines.numbers(table, axis), first[:-1]
        new = np.append(True, place[1:] != place[:-1])
        new[start] = True
        table, place = table.filter(pa.array(new)), place[new]
        first = np.concatenate([[0], np.cumsum(np.add.reduceat(new, start))])
        start = first[:-1]
        to = lines.numbers(table, high)[start]
        line, at, d2 = lines.fill_lines(first, place, lines.numbers(table, "d2"), lines.numbers(table, step)[start],
                                        lines.numbers(table, low)[start] if low else np.zeros(len(to)), to, limit)
        return lines.carried(table, rest, start[line], **{axis: at.astype(np.int32), "d2": d2})

    def becomes(table: pa.Table, first: np.ndarray) -> np.ndarray:
        start = first[:-1]
        to = lines.numbers(table, high)[start] + 1
        return np.maximum(to - lines.numbers(table, low)[start] if low else to, 1)

    return lines.over_lines(df, keys, [axis, "d2"], work, lines.ddl(df, rest, **{axis: "int", "d2": "double"}), exchange, becomes)


def _ask_pass(field: DataFrame, queries: DataFrame, group: list[str], step: str) -> DataFrame:
    """(group, i, j, k, d2) of the queries: each line's lower envelope along i, at the queries only.

    Both sides meet in one exchange by line. d2 is infinite where a line has no targets.
    """
    keys = [*group, "j", "k"]
    both = field.select(*group, *AXES, "d2", step).unionByName(queries.select(*group, *AXES), allowMissingColumns=True)

    def work(table: pa.Table, first: np.ndarray) -> pa.Table:
        line = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place, d2 = lines.numbers(table, "i"), lines.numbers(table, "d2")
        target = ~np.isnan(d2)
        steps = np.ones(len(first) - 1)
        steps[line[target]] = lines.numbers(table, step)[target]
        counts = np.bincount(line[target], minlength=len(steps))
        asked = np.flatnonzero(~target)
        got = lines.envelope_at(np.concatenate([[0], np.cumsum(counts)]), place[target], d2[target], steps, line[asked], place[asked])
        return lines.carried(table, [*group, *AXES], asked, d2=got)

    return lines.over_lines(both, keys, ["i"], work, lines.ddl(both, [*group, *AXES], d2="double"), keys)


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({a: F.col(a).cast("int") for a in AXES})


def signed_distance(segs: DataFrame, classes: list[int], cases: DataFrame, include_background: bool = False,
                    limit: float = DISTANCE_LIMIT) -> DataFrame:
    """(case_id, cls, i, j, k, dist): distance to the class outside it, minus the distance to
    its complement inside, clipped to the limit.

    The nearest voxel of a set is always one that touches its complement, so distances
    start at label edges; voxels nothing reaches are at the limit. cases has shape and
    spacing.
    """
    chosen = sorted({*classes, 0} if include_background else set(classes) - {0})
    edges = _label_edges(segs)
    # an edge voxel is a target for the outside of its own class, and for the inside of the other
    role = F.array(F.struct(F.col("label").cast("int").alias("cls"), F.lit("out").alias("side")),
                   F.struct(F.col("other").cast("int").alias("cls"), F.lit("in").alias("side")))
    seeds = edges.select(*VOXEL, F.inline(role)).filter(F.col("cls").isin(chosen)).withColumn("d2", F.lit(0.0))
    geometry = cases.select("case_id", *[(F.col("shape")[a] - 1).cast("int").alias(f"_hi{a}") for a in (1, 2)],
                            *[F.col("spacing")[a].cast("double").alias(f"_s{a}") for a in range(3)])
    group = ["case_id", "cls", "side"]
    # slabs of constant i hold the lines of both other axes: one exchange serves two passes
    field = _fill_pass(attach(_placed(seeds), geometry, ["case_id"]), group, "k", None, "_hi2", "_s2", limit, [*group, "i"])
    field = _fill_pass(field, group, "j", None, "_hi1", "_s1", limit)
    wanted = segs.select(*VOXEL, F.col("label").cast("int").alias("label"), F.explode(F.array(*[F.lit(c) for c in chosen])).alias("cls")) \
        .withColumn("side", F.when(F.col("label") == F.col("cls"), "in").otherwise("out"))
    found = _ask_pass(field, _placed(wanted), group, "_s0")
    dist = F.least(F.sqrt("d2"), F.lit(limit))
    return found.select("case_id", "cls", *AXES, F.when(F.col("side") == "out", dist).otherwise(-dist).alias("dist"))


# --- surfaces --------------------------------------------------------------------------

def surface_voxels(segs: DataFrame) -> DataFrame:
    """Labelled voxels with a face neighbour of another label or none: (case_id, cls, i, j, k)."""
    out = None
    for axis, table in _by_slab(segs.select(*VOXEL, "label")):
        w = _line(axis)
        open_side = F.lit(False)
        for step in (F.lag, F.lead):
            open_side = open_side | ~step("label").over(w).eqNullSafe(F.col("label"))
        found = table.withColumn("_open", open_side).filter("_open AND label > 0").select(
            "case_id", F.col("label").cast("int").alias("cls"), *AXES)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def nearest_surface(queries: DataFrame, targets: DataFrame, cases: DataFrame, group: tuple[str, ...] = ("case_id", "cls")) -> DataFrame:
    """Distance of each query voxel to the nearest target voxel of its group, which names case and class.

    Targets are reduced line by line (k and j within slabs, then i), within the box of the queries and along i at
    the queries only; the cost of a line is linear, and no pair of far-apart voxels is ever formed.
    Queries without any target are left out.
    """
    group = list(group)
    box = queries.groupBy(*group).agg(*[f(a).cast("int").alias(f"_{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "jk"])
    box = box.join(cases.select("case_id", *[F.col("spacing")[a].cast("double").alias(f"_s{x}") for a, x in enumerate(AXES)]),
                   "case_id")
    field = attach(_placed(targets.select(*group, *AXES)).withColumn("d2", F.lit(0.0)), box, group)
    field = _fill_pass(field, group, "k", "_lok", "_hik", "_sk", exchange=[*group, "i"])
    field = _fill_pass(field, group, "j", "_loj", "_hij", "_sj")
    found = _ask_pass(field, _placed(queries), group, "_si").filter(F.col("d2") != float("inf"))
    return found.select(*group, *AXES, F.sqrt("d2").alias("dist"))


def surface_distance_scores(gt: DataFrame, pred: DataFrame, cases: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Per case and class the 95th percentile of the surface distances of both sides, and the
    share of both surfaces within the tolerance. One side empty: infinite, and 0."""
    a, b = settle(surface_voxels(gt)), settle(surface_voxels(pred))
    keys = ["case_id", "cls"]
    # both directions at once, as groups of their own
    asked = a.withColumn("of", F.lit(0)).unionByName(b.withColumn("of", F.lit(1)))
    sought = b.withColumn("of", F.lit(0)).unionByName(a.withColumn("of", F.lit(1)))
    both = settle(nearest_surface(asked, sought, cases, (*keys, "of")).select(*keys, "dist"))
    sizes = a.unionByName(b).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    near = both.groupBy(*keys).agg(F.count_if(F.col("dist") <= tolerance).alias("_near"))
    hd = percentiles_of_counts(settle(value_counts(both, keys, "dist")), keys, {"hd95": 0.95})
    return sizes.join(near, keys, "left").join(hd, keys, "left").select(
        *keys, F.coalesce("hd95", F.lit(float("inf"))).alias("hd95"),
        (F.coalesce("_near", F.lit(0)) / F.col("_size")).alias("surface_dice"))
