"""Coverage analytics over fact tables, as Spark DataFrame operators."""

from factspan.facts import Facts
from factspan.spec import (
    Dashboard,
    GroupBy,
    Property,
    Qualifier,
    RefCheck,
    Referenced,
    SiteLink,
    Text,
    column_from_key,
    columns_from_text,
    dashboard_from_params,
    link_from_text,
    reference_check,
)

__all__ = [
    "Dashboard",
    "Facts",
    "GroupBy",
    "Property",
    "Qualifier",
    "RefCheck",
    "Referenced",
    "SiteLink",
    "Text",
    "column_from_key",
    "columns_from_text",
    "dashboard_from_params",
    "link_from_text",
    "reference_check",
]
