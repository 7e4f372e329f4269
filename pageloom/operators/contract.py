"""Data-quality rules: result documents, triggers, leads, product events, redaction.

Every rule is a column; a row carries the names of the rules it breaks, so accepted and rejected rows are two filters
over one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.text import matches, trimmed
from pageloom.plans.rubric import DIMENSIONS, GRADES
from pageloom.plans.schema import RESULT
from pageloom.sources.crawl import unwrapped_json

FAILED_REASONS = ("4xx", "5xx", "no-content", "timeout")
PATH_CHARS = 250
# Control characters, zero-width and direction marks, overrides, joiners and isolates, byte-order mark.
UNSAFE_PATH = r"[\x00-\x1f\x7f\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff]"
# Formats of ids and addresses, plans, and domains of throw-away mail.
UUID = (
    r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
    r"|0{8}-0{4}-0{4}-0{4}-0{12}|f{8}-f{4}-f{4}-f{4}-f{12})\z"
)
EMAIL = r"(?i)^(?!\.)(?!.*\.\.)[A-Z0-9_'+\-.]*[A-Z0-9_+-]@(?:[A-Z0-9][A-Z0-9-]*\.)+[A-Z]{2,}\z"
PLANS = ("pro", "agency")
DISPOSABLE_DOMAINS = [
    "mailinator.com", "guerrillamail.com", "guerrillamail.info", "grr.la", "sharklasers.com", "10minutemail.com",
    "10minutemail.net", "temp-mail.org", "tempmail.com", "tempmailo.com", "throwawaymail.com", "yopmail.com",
    "getnada.com", "nada.email", "dispostable.com", "fakeinbox.com", "trashmail.com", "maildrop.cc", "mailnesia.com",
    "mintemail.com", "mohmal.com", "mailcatch.com", "spamgourmet.com", "tempr.email", "emailondeck.com", "mailtemp.net",
    "tmail.ws", "moakt.com", "inboxkitten.com", "burnermail.io", "temp-mail.io", "1secmail.com", "email-temp.com",
    "tmpmail.org", "discard.email", "spam4.me", "fakemail.net",
]
# The keys each product event may carry besides its name.
EVENT_KEYS = {
    "sign_up": ["method"],
    "login": ["method"],
    "audit_started": ["audit_domain"],
    "audit_completed": ["audit_domain", "report_id", "audit_status"],
    "report_viewed": ["report_id"],
    "sample_report_viewed": ["sample_id"],
    "chat_message_sent": ["chat_message_length"],
    "contact_cta_click": ["audit_domain"],
}
SENSITIVE_FIELDS = ("pages", "pagesFailed", "failing", "sourceURL", "rootUrl")


def safe_path(path: Column) -> Column:
    return path.isNotNull() & F.length(path).between(1, PATH_CHARS) & ~matches(path, UNSAFE_PATH)


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in rule order; an unknown answer counts as broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
                    lambda v: v.isNotNull())


def _type(doc: Column, field: str) -> Column:
    """Type name of a top-level field: NULL if absent, VOID for a JSON null."""
    return F.schema_of_variant(F.variant_get(doc, f"$.{field}", "variant"))


def validate_results(df: DataFrame, column: str) -> DataFrame:
    """Adds ``tier`` (strict, minimal or rejected) and ``violations`` to rows holding a result document as text.

    The strict rules cover types, ranges and closed lists, and, once those hold, that every failing path is an audited
    path. A document that breaks one still passes as minimal if it has the fields a reader maps over.
    """
    v, d = F.col("_doc"), F.col("_typed")
    number = lambda f: F.coalesce(matches(_type(v, f), r"^(?:BIGINT|DOUBLE|DECIMAL)"), F.lit(False))
    array = lambda f: F.coalesce(F.startswith(_type(v, f), F.lit("ARRAY")), F.lit(False))
    absent = lambda f: _type(v, f).isNull()
    count = lambda f: absent(f) | (number(f) & (d[f] >= 0) & (d[f] == F.floor(d[f])))
    ids = [x[0] for x in DIMENSIONS]
    check_ok = lambda c: c["id"].isNotNull()
    dim_ok = lambda x: (
        x["id"].isin(*ids) & x["label"].isNotNull() & x["score"].isNotNull() & x["rawScore"].isNotNull()
        & x["capped"].isNotNull() & x["checks"].isNotNull() & F.forall(x["checks"], check_ok))
    known = F.transform(d["pages"], lambda p: p["path"])
    listed = F.flatten(F.transform(d["dimensions"], lambda x: F.flatten(F.transform(
        x["checks"], lambda c: F.coalesce(F.transform(c["evidence"]["failing"], lambda f: f["path"]),
                                          F.array().cast("array<string>"))))))
    rules = {
        "overall": number("overall") & d["overall"].between(0, 100),
        "grade": (_type(v, "grade") == "STRING") & d["grade"].isin(*[g for g, _ in GRADES]),
        "capped": _type(v, "capped") == "BOOLEAN",
        "dimensions": array("dimensions") & (F.size(d["dimensions"]) == 4) & F.forall(d["dimensions"], dim_ok),
        "actionPlan": array("actionPlan") & F.forall(d["actionPlan"], lambda a: a["checkId"].isNotNull()
                                                     & a["finding"].isNotNull() & a["severity"].isNotNull()),
        "pages": absent("pages") | (array("pages") & F.forall(d["pages"], lambda p: safe_path(p["path"]))),
        "pagesWithIssues": count("pagesWithIssues"),
        "pagesExcluded": count("pagesExcluded"),
        "pagesFailed": absent("pagesFailed") | (array("pagesFailed") & F.forall(
            d["pagesFailed"], lambda p: safe_path(p["path"]) & p["reason"].isin(*FAILED_REASONS))),
    }
    mirror = absent("pages") | (F.size(F.array_except(listed, known)) == 0)
    minimal = number("overall") & array("dimensions") & array("actionPlan")
    text = unwrapped_json(F.col(column))
    first_pass = (
        df.withColumn("_text", text)
        .withColumns({"_doc": F.try_parse_json("_text"), "_typed": F.from_json("_text", RESULT, {"mode": "PERMISSIVE"})})
        .withColumn("_broken", broken(rules))
    )
    broken_all = F.when(F.size("_broken") > 0, F.col("_broken")).when(
        ~F.coalesce(mirror, F.lit(False)), F.array(F.lit("mirror"))).otherwise(F.array().cast("array<string>"))
    return (
        first_pass.withColumn("violations", F.when(v.isNull(), F.array(F.lit("json"))).otherwise(broken_all))
        .withColumn("tier", F.when(F.size("violations") == 0, "strict").when(
            F.coalesce(minimal, F.lit(False)), "minimal").otherwise("rejected"))
        .drop("_text", "_doc", "_typed", "_broken")
    )


def trigger_violations(report_id: Column, root_url: Column, domain: Column) -> Column:
    return broken({
        "reportId": matches(report_id, UUID),
        "rootUrl": matches(root_url, r"(?i)^[a-z][a-z0-9+.-]*://[^\s/?#]+"),
        "domain": F.length(domain) >= 1,
    })


def lead_violations(c: dict[str, Column]) -> Column:
    """Rules of the contact form; texts are trimmed first, absent optional fields pass."""
    size = lambda f: F.length(trimmed(c[f]))
    optional = lambda f, n: c[f].isNull() | (size(f) <= n)
    return broken({
        "name": size("name").between(2, 100),
        "email": matches(trimmed(c["email"]), EMAIL) & (size("email") <= 200),
        "message": size("message").between(10, 2000),
        "plan": c["plan"].isNull() | c["plan"].isin(*PLANS),
        "company": optional("company", 120),
        "topic": optional("topic", 60),
    })


def lead_backstop_violations(c: dict[str, Column]) -> Column:
    """The looser constraint of the table itself."""
    optional = lambda f, n: c[f].isNull() | (F.length(c[f]) <= n)
    return broken({
        "handled": ~c["handled"],
        "name": F.length(c["name"]).between(1, 200),
        "email": F.length(c["email"]).between(3, 320),
        "message": F.length(c["message"]).between(1, 5000),
        "company": optional("company", 200),
        "topic": optional("topic", 100),
        "plan": optional("plan", 50),
    })


def is_disposable(email: Column) -> Column:
    """Domain after the last '@' is a known throw-away provider; 37 literals, so no join."""
    domain = F.lower(trimmed(F.substring_index(email, "@", -1)))
    return F.contains(email, F.lit("@")) & domain.isin(*DISPOSABLE_DOMAINS)


def event_violations(name: Column, keys: Column) -> Column:
    """Keys an event carries beyond its contract; every key if the event is unknown."""
    allowed = F.create_map(*[x for k, v in EVENT_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_except(keys, F.coalesce(F.try_element_at(allowed, name), F.array().cast("array<string>")))


def _hint(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        text = F.concat(F.lit("[scrubbed] ("), F.size(c).cast("string"), F.lit(" entries)"))
    elif isinstance(dtype, T.StringType):
        text = F.concat(F.lit("[scrubbed] ("), F.length(c).cast("string"), F.lit(" chars)"))
    else:
        text = F.lit("[scrubbed]")
    return F.when(c.isNull(), F.lit("[scrubbed]")).otherwise(text)


def _scrub(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_field(c[f.name], f).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda e: _scrub(e, dtype.elementType))
    return c


def _field(c: Column, field: T.StructField) -> Column:
    return _hint(c, field.dataType) if field.name in SENSITIVE_FIELDS else _scrub(c, field.dataType)


def redact_fields(df: DataFrame) -> DataFrame:
    """Values of the sensitive fields become a marker with their size, at any depth of the schema."""
    return df.select(*[_field(F.col(f.name), f).alias(f.name) for f in df.schema.fields])
