"""Short ways to write small fact tables."""

from itertools import count

from factspan import Facts
from factspan.facts import UNKNOWN_PREFIX

_ids = count(1)


class Graph:
    """Collects rows; ``facts`` makes the tables."""

    def __init__(self):
        self.rows = {
            name: []
            for name in (
                "claims",
                "qualifiers",
                "reference_nodes",
                "reference_snaks",
                "terms",
                "sitelinks",
                "projects",
            )
        }

    def claim(
        self,
        entity,
        prop,
        value=None,
        rank="normal",
        snak="value",
        year=None,
        kind=None,
        quals=(),
        refs=(),
    ):
        """A statement; ``quals`` are (property, value or None), ``refs`` lists of snaks."""
        statement = f"s{next(_ids)}"
        if snak == "somevalue":
            value = value or f"{UNKNOWN_PREFIX}{statement}"
        kind = kind or ("time" if year is not None else "item")
        self.rows["claims"].append(
            (entity, prop, statement, rank, snak, kind, value, None, year)
        )
        for qualifier, found in quals:
            self.rows["qualifiers"].append(
                (statement, qualifier, "novalue" if found is None else "value", found)
            )
        for snaks in refs:
            self.node(statement, f"r{next(_ids)}", snaks)
        return statement

    def node(self, statement, reference, snaks=()):
        self.rows["reference_nodes"].append((statement, reference))
        for prop, value in snaks:
            self.rows["reference_snaks"].append((reference, prop, value))

    def label(self, entity, lang, text, kind="label"):
        self.rows["terms"].append((entity, kind, lang, text))

    def link(self, entity, url, title="page"):
        self.rows["sitelinks"].append((entity, url, title))

    def facts(self, spark) -> Facts:
        return Facts.from_rows(spark, **self.rows)


def bag(spark, *entities):
    return spark.createDataFrame([(e,) for e in entities], "entity_id string")
