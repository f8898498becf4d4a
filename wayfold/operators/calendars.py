"""Service days over several feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days between the start of the shared range and the first day that counts, so that a change of timetables is behind.
SETTLED_DAYS = 7


def _date(c: str) -> Column:
    return F.to_date(c, "yyyyMMdd")


def common_day(calendar: DataFrame, dates: DataFrame, trips: DataFrame, weekday: str = "wednesday", settled: int = SETTLED_DAYS) -> DataFrame:
    """(service_date): the first such weekday, as yyyyMMdd, on which trips run in every feed; null if there is none.

    calendar and dates carry a feed column. The range is what the feeds with that weekday in their calendar share, from `settled` days after its start. A feed
    that only has exceptions takes part, too. Services without trips run nowhere.
    """
    regular = calendar.where(F.col(weekday) == "1").select("feed", "service_id", _date("start_date").alias("a"), _date("end_date").alias("b"))
    shared = regular.groupBy("feed").agg(F.min("a").alias("a"), F.max("b").alias("b")).agg(F.date_add(F.max("a"), settled).alias("lo"), F.min("b").alias("hi"))  # one row
    on = F.date_format("day", "EEEE") == weekday.capitalize()
    within = regular.join(F.broadcast(shared)).withColumn("a", F.greatest("a", "lo")).withColumn("b", F.least("b", "hi")).where("a <= b")
    days = within.select("feed", "service_id", F.explode(F.sequence("a", "b")).alias("day")).where(on)
    changed = dates.select("feed", "service_id", _date("date").alias("day"), "exception_type")
    kept = days.join(changed.where("exception_type = '2'"), ["feed", "service_id", "day"], "left_anti")
    added = changed.where("exception_type = '1'").join(F.broadcast(shared)).where(F.col("day").between(F.col("lo"), F.col("hi"))).where(on)
    running = kept.union(added.select("feed", "service_id", "day")).join(trips.select("service_id").distinct(), "service_id", "left_semi")
    feeds = calendar.select("feed").union(dates.select("feed")).agg(F.count_distinct("feed").alias("feeds"))  # one row
    full = running.groupBy("day").agg(F.count_distinct("feed").alias("n")).join(F.broadcast(feeds)).where("n = feeds")
    return full.agg(F.date_format(F.min("day"), "yyyyMMdd").alias("service_date"))
