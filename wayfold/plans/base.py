"""Registration of queries: a function of the network, and SQL over the same tables where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from wayfold.operators.rounds import path_of
from wayfold.sources.network import TABLES, Network, oracle_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Baked = TypeVar("Baked")


def baked(n: Network, name: tuple, build: Callable[[], Baked]) -> Baked:
    """What build() makes of a network, tables in the run's folder, made once in an application for the same source files.

    Many queries start from the same searches of one destination; they are told apart by name, folder and the files' times.
    """
    held = n.spark.sparkContext.__dict__.setdefault("_wayfold_baked", {})
    times = []
    for t in TABLES:
        fs, p = path_of(n.spark, f"{n.sf_dir}/{t}.parquet")
        times.append(fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None)
    key = (n.sf_dir, tuple(times), name)
    if key not in held:
        held[key] = build()
    return held[key]


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Network], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Network(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle_with(sql)
        return build

    return register
