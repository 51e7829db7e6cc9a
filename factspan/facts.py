"""The fact tables a dashboard reads."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the public RDF mapping: skolem ids of unknown values, entity ids.
UNKNOWN_PREFIX = "http://www.wikidata.org/.well-known/genid/"
ENTITY_PREFIX = "http://www.wikidata.org/entity/"

SCHEMAS = {
    "claims": (
        "entity_id string, property string, statement_id string, rank string, "
        "snak_type string, value_type string, value string, time_value timestamp_ntz, "
        "time_year bigint"
    ),
    "qualifiers": "statement_id string, property string, snak_type string, value string",
    "reference_nodes": "statement_id string, reference_id string",
    "reference_snaks": "reference_id string, property string, value string",
    "terms": "entity_id string, kind string, lang string, text string",
    "sitelinks": "entity_id string, project_url string, title string",
    "projects": "code string, url string, item string",
}


@dataclass(frozen=True)
class Facts:
    claims: DataFrame
    qualifiers: DataFrame
    reference_nodes: DataFrame
    reference_snaks: DataFrame
    terms: DataFrame
    sitelinks: DataFrame
    projects: DataFrame
    unknown_prefix: str = UNKNOWN_PREFIX
    entity_prefix: str = ENTITY_PREFIX

    @property
    def spark(self) -> SparkSession:
        return self.claims.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows) -> Facts:
        """Facts from small row lists; tables not given are empty."""
        return cls(
            **{
                name: spark.createDataFrame(rows.get(name, []), schema)
                for name, schema in SCHEMAS.items()
            }
        )

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Facts:
        """Read tables written by :meth:`write`."""
        return cls(
            **{
                name: spark.read.schema(schema).parquet(f"{path}/{name}")
                for name, schema in SCHEMAS.items()
            }
        )

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Write the tables as parquet; claims and qualifiers are laid out by property.

        The rebalance hint keeps one property in few files and splits a property
        that holds a large share of the rows.
        """
        for name, table in self.tables().items():
            if name in ("claims", "qualifiers"):
                table = table.hint("rebalance", "property")
                table.write.mode(mode).partitionBy("property").parquet(f"{path}/{name}")
            else:
                table.write.mode(mode).parquet(f"{path}/{name}")

    def project_table(self, codes: Iterable[str] | None = None) -> dict[str, tuple[str, str]]:
        """Project code -> (url, item), of the ``codes`` a configuration names.

        Without ``codes`` the whole dimension is fetched: for small ones only.
        """
        rows = self.projects
        if codes is not None:
            rows = rows.filter(F.col("code").isin(*codes))
        return {row.code: (row.url, row.item) for row in rows.collect()}


def has_value(snak_type="snak_type"):
    """A main value, known or not: everything but an explicit "none"."""
    return F.col(snak_type) != "novalue"
