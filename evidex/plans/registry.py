"""Where checks are registered: one Spark query and, where SQL can say it, one oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evidex.plans.views import Catalog, prelude
from evidex.session import configure


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[Catalog], DataFrame]
    oracle: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None, needs: str = ""):
    """Register ``fn(catalog) -> DataFrame``; ``needs`` lists the views the SQL reads."""

    def wrap(fn: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        if name in CHECKS:
            raise ValueError(f"check {name!r} is registered twice")
        CHECKS[name] = Check(name, fn, prelude(needs.split(), sql) if sql else None)
        return fn

    return wrap


def as_query(item: Check) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return item.run(Catalog(configure(spark), sf_dir))

    run.__name__ = item.name
    return run
