"""Chains of filters: DataFrame -> DataFrame steps by name, in the order a user gives, with each step's result kept if wanted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.settled import settled

FILTERS: dict[str, Callable[..., DataFrame]] = {}


def register_filter(name: str, step: Callable[..., DataFrame]) -> None:
    """Make a step known by name. Its first argument is the table, the others are settings; it returns the table for the next one."""
    if name in FILTERS and FILTERS[name] is not step:
        raise ValueError(f"there is another filter named {name}")
    FILTERS[name] = step


def run_chain(rows: DataFrame, steps: list[tuple[str, dict]], dump: str | None = None, settle: bool = False, done: int = 0) -> DataFrame:
    """rows after the steps (name, settings) in order.

    dump: a folder where each step's result is written, as 00-name, 01-name, ..., and read on from; with it, `done` steps of an earlier
    run are taken from there and not run again. settle: results are checkpointed instead of written.
    """
    unknown = [name for name, _ in steps if name not in FILTERS]
    if unknown:
        raise ValueError(f"no filter is named {unknown[0]}; known are {', '.join(sorted(FILTERS))}")
    paths = [f"{dump}/{k:02d}-{name}" for k, (name, _) in enumerate(steps)]
    if done:
        rows = rows.sparkSession.read.parquet(paths[done - 1])
    for path, (name, settings) in list(zip(paths, steps))[done:]:
        rows = FILTERS[name](rows, **settings)
        if dump:
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
            rows = rows.sparkSession.read.parquet(path)
        elif settle:
            rows = settled(rows)
    return rows
