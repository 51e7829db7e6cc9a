"""Many property paths followed at once; which path an entity takes is data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.facts import Facts, has_value
from factspan.operators.selection import truthy
from factspan.operators.tables import written


class Steps:
    """Paths by name as a table (path, step, property, last)."""

    def __init__(self, spark: SparkSession, paths: Mapping[str, Sequence[str]]):
        self.paths = dict(paths)
        self.depth = max(map(len, self.paths.values()), default=0)
        rows = [
            (name, step, prop, step == len(path) - 1)
            for name, path in self.paths.items()
            for step, prop in enumerate(path)
        ]
        schema = "path string, step int, property string, last boolean"
        self.table = written(spark.createDataFrame(rows, schema).coalesce(1))

    def properties(self, step: int) -> list[str]:
        return sorted({path[step] for path in self.paths.values() if step < len(path)})


def followed(facts: Facts, starts: DataFrame, steps: Steps, near: Facts | None = None) -> DataFrame:
    """(path, entity_id, value, value_type, snak_type, time_year) where paths end.

    ``starts`` are distinct (path, entity_id); ``near`` has the facts of their entities,
    where these are cut down. The plan grows with the longest path only. Rows are not
    distinct.
    """
    ends = ["value", "value_type", "snak_type", "time_year"]
    here = starts.select("path", "entity_id", F.col("entity_id").alias("_at"))
    found = None
    for step in range(max(steps.depth, 1)):
        claims = truthy(near if near and step == 0 else facts, steps.properties(step))
        claims = claims.filter(has_value()).select(F.col("entity_id").alias("_at"), "property", *ends)
        wanted = steps.table.filter(F.col("step") == step).drop("step")
        rows = here.join(wanted, "path").join(claims, ["_at", "property"])
        arrived = rows.filter("last").select("path", "entity_id", *ends)
        found = arrived if found is None else found.unionByName(arrived)
        here = rows.filter("not last").select("path", "entity_id", F.col("value").alias("_at"))
        here = here.distinct()
    return found
