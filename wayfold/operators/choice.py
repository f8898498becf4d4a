"""Choosing among a cell's route options: ranks, dominance, families, diversity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quality: total, exact seconds, access walk, transfers, final walk, fragility, later boarding first, no ride of a minute before a long walk, tie key.
RANK = ("minutes", "exact_s", "access_walk", "transfers", "final_walk", "frag_min", "anchor_neg", "token_ride", "line_id", "option_id")
#: What dominance compares.
CRITERIA = ("minutes", "exact_s", "access_walk", "transfers", "final_walk", "walk_min", "frag_min")
#: After the metric: physical walk, transfers, fragility, exact seconds, later boarding first, tie key.
RECOMMENDATION = ("walk_min", "transfers", "frag_min", "exact_s", "anchor_neg", "line_id", "option_id")
PLANNED_RANK = ("exact_s", "minutes", "anchor_neg", "access_walk", "transfers", "walk_min", "final_walk", "line_id", "option_id")


def ranked(options: DataFrame, order: tuple[str, ...] = RANK) -> DataFrame:
    return options.withColumn("rank", F.row_number().over(Window.partitionBy("cell_id").orderBy(*order)).cast("long"))


def pareto(options: DataFrame, within: tuple[str, ...] = ("cell_id", "family", "branch"), criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Options that no other of their group matches in all criteria and beats in one.

    Rows alike in all criteria are one point, so a self-join meets each point once, whatever the number of copies.
    """
    points = options.select(*within, *criteria).distinct()
    other = points.select(*within, *(F.col(c).alias(f"o_{c}") for c in criteria))
    no_worse = F.lit(True)
    better = F.lit(False)
    for c in criteria:
        no_worse = no_worse & (F.col(f"o_{c}") <= F.col(c))
        better = better | (F.col(f"o_{c}") < F.col(c))
    beaten = points.join(other, list(within)).where(no_worse & better).select(*within, *criteria).distinct()
    return options.join(beaten, [*within, *criteria], "left_anti")


def recommended(options: DataFrame) -> DataFrame:
    """(cell_id, typical, best): the option, the primary among them, with the least typical total (delays counted) and the least scheduled one."""
    first = lambda metric: F.min_by("option_id", F.struct(metric.alias("metric"), *RECOMMENDATION))
    return options.groupBy("cell_id").agg(first(F.col("minutes") + F.col("frag_min")).alias("typical"), first(F.col("minutes")).alias("best"))


def chips(options: DataFrame, cap: int = 6) -> DataFrame:
    """Lines beside the primary one, closest to it first, at most cap."""
    lines = options.groupBy("cell_id", "line_id").agg(F.min("minutes").alias("minutes"))
    order = Window.partitionBy("cell_id").orderBy("minutes", "line_id")
    return lines.withColumn("k", F.row_number().over(order)).where((F.col("k") > 1) & (F.col("k") <= cap + 1)).select("cell_id", "line_id", "minutes", (F.col("k") - 1).cast("long").alias("chip"))


def family_names(options: DataFrame, shown: int = 3) -> DataFrame:
    """(cell_id, family, name): 'A / B / C +n' from the family's lines by their best minute."""
    lines = options.groupBy("cell_id", "family", "line_id").agg(F.min("minutes").alias("m")).groupBy("cell_id", "family").agg(F.sort_array(F.collect_list(F.struct("m", "line_id"))).alias("x"))
    names = F.transform("x", lambda l: F.concat(F.lit("L"), l["line_id"].cast("string")))
    more = F.when(F.size(names) > shown, F.concat(F.lit(" +"), (F.size(names) - shown).cast("string"))).otherwise("")
    return lines.select("cell_id", "family", F.concat(F.array_join(F.slice(names, 1, shown), " / "), more).alias("name"))


def _cells(options: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per cell: its options in rank order, a column of arrays for each field."""
    own = F.sort_array(F.collect_list(F.struct(*RANK, *(f for f in fields if f not in RANK))))
    rows = options.groupBy("cell_id").agg(own.alias("x"))
    return rows.select("cell_id", *(F.col(f"x.{f}").alias(f) for f in fields))


def _picked(cells: pd.Series, options: list[list], numbers: list[list], name: str) -> pd.DataFrame:
    sizes = [len(o) for o in options]
    return pd.DataFrame({"cell_id": np.repeat(cells.to_numpy(), sizes), "option_id": list(chain.from_iterable(options)), name: list(chain.from_iterable(numbers))})


def choose(options: list[int], family: list[int], branch: list[int], k: int) -> list[int]:
    """The options, in rank order, that diverse() takes."""
    queues: dict[int, list[int]] = {}
    for n, f in enumerate(family):
        queues.setdefault(f, []).append(n)
    picked = [q.pop(0) for q in list(queues.values())[:k]]
    if picked and len(picked) < k:
        best = picked[0]
        sibling = next((n for n in queues[family[best]] if branch[n] != branch[best]), None)
        if sibling is not None:
            queues[family[best]].remove(sibling)
            picked.append(sibling)
    while len(picked) < k and any(queues.values()):
        for q in queues.values():
            if q and len(picked) < k:
                picked.append(q.pop(0))
    return [options[n] for n in picked]


def diverse(options: DataFrame, k: int = 4) -> DataFrame:
    """(cell_id, option_id, slot): one option of each family first, a sibling branch of the best family, then round-robin.

    Each choice depends on those before, so a cell's options, a few dozen, are one row for Python.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [choose(o.tolist(), f.tolist(), b.tolist(), k) for o, f, b in zip(part["option_id"], part["family"], part["branch"], strict=True)]
            yield _picked(part["cell_id"], found, [list(range(len(o))) for o in found], "slot")

    return _cells(options, ("option_id", "family", "branch")).mapInPandas(run, "cell_id long, option_id long, slot long")


def cluster(walk: list[int], minutes: list[int], reach: int) -> list[int]:
    """The cluster of each option, in rank order: the first all of whose members are near."""
    clusters: list[list[int]] = []
    out = []
    for n, (w, m) in enumerate(zip(walk, minutes, strict=True)):
        for c, own in enumerate(clusters):
            if all(abs(w - walk[o]) <= reach and abs(m - minutes[o]) <= 4 * reach for o in own):
                own.append(n)
                break
        else:
            c = len(clusters)
            clusters.append([n])
        out.append(c)
    return out


def families(options: DataFrame, reach: int = 3) -> DataFrame:
    """(cell_id, option_id, cluster): greedy complete-link clusters of options of like walk and minutes, in rank order.

    Greedy clustering is not transitive, so it isn't a component of a graph; a cell's options are one row for Python.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [cluster(w.tolist(), m.tolist(), reach) for w, m in zip(part["walk_min"], part["minutes"], strict=True)]
            yield _picked(part["cell_id"], [o.tolist() for o in part["option_id"]], found, "cluster")

    return _cells(options, ("option_id", "walk_min", "minutes")).mapInPandas(run, "cell_id long, option_id long, cluster long")
