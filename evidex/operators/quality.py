"""Corpus quality: a table of expectations, schema contracts, vocabulary invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.session import literal_table


def below_floor(items: DataFrame, floors: DataFrame, key: str) -> DataFrame:
    """Sources that produced something but less than their floor; a source with nothing yet is not judged."""
    loaded = items.groupBy(key).agg(F.count(F.lit(1)).alias("loaded"))
    return loaded.join(floors, key).filter("floor_rows is not null and loaded < floor_rows")


def verdicts(measured: DataFrame, limits: list[tuple[str, str, str, float]]) -> DataFrame:
    """(name, severity, observed, bound, ok) from (name, observed) measurements.

    ``limits`` rows are (measurement, severity, op, limit) with op one of ``>=``, ``<=``, ``report``.
    """
    rules = F.broadcast(literal_table(measured.sparkSession, "name string, severity string, op string, bound double", limits))
    ok = (F.when(F.col("op") == "report", True).when(F.col("op") == ">=", F.col("observed") >= F.col("bound"))
          .otherwise(F.col("observed") <= F.col("bound")))
    return measured.join(rules, "name").select("name", "severity", "observed", "bound", ok.alias("ok"))


def measure(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every corpus measurement as (name, observed): one aggregate per table."""
    def long(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        row = df.agg(*[agg.alias(name) for name, agg in metrics.items()])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("observed")) for name in metrics])))

    confident_empty = ((F.col("role").isin("layered", "other")) & F.col("coat").isNull() & F.col("clay").isNull()
                       & F.col("layered_over").isNull())
    bare = items.join(evidence.select("item_id"), "item_id", "left_anti")
    return (
        long(items, {
            "items": F.count(F.lit(1)), "items_without_range": F.count_if(F.col("lo").isNull()),
            "share_with_terms": F.count_if(F.size("terms") > 0) / F.count(F.lit(1))})
        .unionByName(long(evidence, {
            "leaked_icons": F.count_if(F.contains("source_url", F.lit("image-manager"))),
            "confident_but_empty": F.count_if(confident_empty), "links_resolved": F.count("layered_over"), "with_clay": F.count("clay"),
            "unsplit_composites": F.count_if((F.col("role") == "coats_composite") & F.col("coat").isNull()),
            "distinct_assets": F.count_distinct("hex")}))
        .unionByName(long(bare, {"items_without_evidence": F.count(F.lit(1))})))


def schema_contract(df: DataFrame, expected: T.StructType) -> list[str]:
    """How a frame's ordered columns differ from the frozen ones; empty when they agree."""
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    problems = [f"missing {w[0]} {w[1]}" for w in want if w not in got] + [f"unexpected {g[0]} {g[1]}" for g in got if g not in want]
    if not problems and got != want:
        problems.append("columns are in another order")
    return problems


def vocabulary_violations(entries: DataFrame, scope: str, key: str, ordinal: str) -> DataFrame:
    """Keys or ordinals used twice within one scope."""
    out = None
    for column in (key, ordinal):
        twice = (entries.groupBy(scope, F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
                 .filter("n > 1").select(F.lit(f"duplicate_{column}").alias("violation"), F.col(scope).cast("string").alias("scope"), "value", "n"))
        out = twice if out is None else out.unionByName(twice)
    return out


def terms_without_family(terms: DataFrame) -> DataFrame:
    """Specialised terms that no plain word leads to."""
    return terms.filter("specialised and family is null").select("term")
