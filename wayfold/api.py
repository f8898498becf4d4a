"""The engine's entry points: DataFrames in, DataFrames out.

    compute    minutes from every cell to a destination, planned
    arrive_by  minutes for one deadline, and the stop behind each
    itinerary  the legs behind each stop's label
    variance   reliability of each cell's committed first leg over delay draws
    batch      compute for many destinations at once: the destination is one more key of every step
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import assemble, reliability, search


@dataclass
class Timetable:
    """stop_time(pattern_id, trip_id, pos, stop_id, arr_s, dep_s), transfer(from_id, to_id, walk_s), cell(cell_id),
    access(cell_id, stop_id, walk_s)."""

    stop_time: DataFrame
    transfer: DataFrame
    cell: DataFrame
    access: DataFrame


@dataclass
class Destination:
    """egress(stop_id, walk_s) and purewalk(cell_id, walk_only_s)."""

    egress: DataFrame
    purewalk: DataFrame


@dataclass
class Window:
    """Departures of the cells and how far past them boarding is looked at."""

    first_s: int = 28800
    last_s: int = 30600
    step_s: int = 60
    cap_min: int = assemble.CAP_MIN

    def departures(self) -> list[int]:
        return search.grid(self.first_s, self.last_s, self.step_s)

    def deadlines(self) -> list[int]:
        return search.grid(self.first_s, self.last_s + 60 * self.cap_min, self.step_s)


def profile(t: Timetable, to: Destination, window: Window, rounds: int = search.MAX_ROUNDS) -> DataFrame:
    return search.monotone(search.reverse_search(search.lanes(t.stop_time), t.transfer, search.seed(to.egress, window.deadlines()), rounds=rounds))


def compute(t: Timetable, to: Destination, window: Window | None = None, rounds: int = search.MAX_ROUNDS) -> DataFrame:
    window = window or Window()
    arrivals = search.arrival_profile(profile(t, to, window, rounds), window.departures())
    return assemble.planned(t.cell, t.access, arrivals, to.purewalk, window.departures(), window.cap_min)


def arrive_by(t: Timetable, to: Destination, deadline_s: int, rounds: int = search.MAX_ROUNDS) -> DataFrame:
    labels = search.reverse_search(search.lanes(t.stop_time), t.transfer, search.seed(to.egress, [deadline_s]), rounds=rounds)
    return assemble.arrive_by(t.cell, t.access, labels, to.purewalk, deadline_s)


def itinerary(t: Timetable, to: Destination, deadline_s: int, rounds: int = search.MAX_ROUNDS) -> DataFrame:
    labels, history = search.traced_search(t.stop_time, t.transfer, search.seed(to.egress, [deadline_s]), rounds=rounds)
    return search.trace(labels, history, rounds=rounds)


def variance(t: Timetable, to: Destination, commits: DataFrame, draws: DataFrame, chains: DataFrame, deadlines: list[int], rounds: int = search.MAX_ROUNDS) -> DataFrame:
    times = reliability.delayed(t.stop_time, draws, chains)
    start = search.seed(to.egress, deadlines).join(F.broadcast(draws.select("draw_id").distinct()))  # a few dozen draws
    late = search.monotone(search.reverse_search(search.lanes(times, chains, ("draw_id",)), t.transfer, start, ("draw_id", "deadline_s"), rounds, time_keys=("draw_id",)), ("draw_id",))
    return reliability.summary(reliability.scored(reliability.next_committed(commits, times), late), ["cell_id"])


def batch(t: Timetable, egress: DataFrame, deadline_s: int, rounds: int = search.MAX_ROUNDS) -> DataFrame:
    """(dest_id, cell_id, minutes) for every destination of egress(dest_id, stop_id, walk_s), in one search."""
    labels = search.reverse_search(search.lanes(t.stop_time), t.transfer, search.seed(egress, [deadline_s]), ("dest_id", "deadline_s"), rounds)
    home = t.access.join(labels, "stop_id").groupBy("dest_id", "cell_id").agg(F.max(F.col("v") - F.col("walk_s")).alias("home"))
    return home.select("dest_id", "cell_id", assemble.shown(F.ceil((F.lit(deadline_s) - F.col("home")) / 60)).cast("long").alias("minutes")).where("minutes is not null")
