"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = (
    "report_id string, page_ord bigint, source_url string, status_code int, title string, description string, "
    "language string, markdown string, html string, raw_html string, links array<string>"
)
SITE_AUX = (
    "report_id string, root_url string, robots_fetched boolean, robots_txt string, sitemap_found boolean, "
    "llms_txt_found boolean, headers_fetched boolean, headers map<string,string>, root_html string, gtm_body string"
)
# One flat record for the ten kinds of failure; fields a kind does not use stay NULL.
_REASON_FIELDS = [
    ("kind", T.StringType()), ("actual", T.IntegerType()), ("min", T.IntegerType()), ("max", T.IntegerType()),
    ("expected_n", T.IntegerType()), ("code", T.IntegerType()), ("what", T.StringType()), ("expected", T.StringType()),
    ("actual_s", T.StringType()), ("note", T.StringType()),
]
REASON = T.StructType([T.StructField(n, t) for n, t in _REASON_FIELDS])

RESULT = (
    "overall double, grade string, capped boolean, "
    "dimensions array<struct<id:string,label:string,score:double,rawScore:double,capped:boolean,"
    "notApplicable:boolean,checks:array<struct<id:string,label:string,ratio:double,severity:string,"
    "evidence:struct<where:string,checked:int,more:int,failing:array<struct<path:string>>>>>>>, "
    "actionPlan array<struct<checkId:string,finding:string,severity:string>>, "
    "pages array<struct<path:string>>, pagesWithIssues double, pagesExcluded double, "
    "pagesFailed array<struct<path:string,reason:string>>"
)


def reason(kind: str, **fields) -> Column:
    """A failure record of one kind."""
    cols = []
    for f in REASON.fields:
        value = F.lit(kind) if f.name == "kind" else fields.get(f.name)
        value = value if isinstance(value, Column) else F.lit(value)
        cols.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*cols)


def no_reason() -> Column:
    return F.lit(None).cast(REASON)


def missing(what: str) -> Column:
    return reason("missing", what=what)
