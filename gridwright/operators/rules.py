"""Data-quality rules producing ``issues`` rows (VAL-1..VAL-8, VAL-14,
AGG-11).

A rule is a predicate ``Column`` that is true when a row has the issue. All
rules on one table are fused into one scan: the fired rules of a row are the
set bits of an integer, which are exploded into issue rows.

Issue schema: ``key columns..., rule, field, value, severity, code, message,
suggestion``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import as_col, quote
from ..session import scratch_path

ISSUE_FIELDS = ["rule", "field", "value", "severity", "code", "message", "suggestion"]
SEVERITIES = ("info", "warning", "error", "critical")
BLOCKING = ("error", "critical")


@dataclass(frozen=True)
class Rule:
    name: str
    field: str
    predicate: Column          # true → the row has this issue
    severity: str = "error"
    code: str | None = None
    message: Column | str = ""
    suggestion: str | None = None
    value: Column | None = None


WORD = 62  # rules per mask word


def validate(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """Evaluate all rules in one pass; one output row per (row, failed rule).

    A row's fired rules are the set bits of an integer (one per ``WORD``
    rules), so every predicate is evaluated once; rows without a set bit are
    dropped before anything else is built. The set bits are exploded; texts of
    a rule come from literal lists by its number, its value and message only
    for the rule that fired."""
    key = list(key)
    if not rules:
        return empty_issues(df.sparkSession, df.select(*[quote(k) for k in key]).schema)
    words = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(r.predicate, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                                                  for i, r in enumerate(rules[w:w + WORD])]) for w in range(0, len(rules), WORD)]
    # the explode between masks and filter keeps the optimizer from writing the predicates into the filter once more
    fired = df.select("*", F.posexplode(F.array(*words)).alias("_issue_word", "_issue_mask")).filter(F.col("_issue_mask") != 0)
    bits = F.expr(f"filter(sequence(0, {min(WORD, len(rules)) - 1}), i -> (_issue_mask & shiftleft(1L, i)) <> 0)")
    each = fired.select("*", F.explode(bits).alias("_issue_bit")).withColumn("_issue_no", F.col("_issue_word") * WORD + F.col("_issue_bit"))

    def listed(values) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("_issue_no") + 1)

    def chosen(columns) -> Column:
        out = F.when(F.col("_issue_no") == 0, columns[0])
        for i, c in enumerate(columns[1:], 1):
            out = out.when(F.col("_issue_no") == i, c)
        return out

    values = [(r.value if r.value is not None else as_col(r.field)).cast("string") for r in rules]
    texts = [r.message.cast("string") if isinstance(r.message, Column) else None for r in rules]
    message = listed([r.message if t is None else None for r, t in zip(rules, texts)])
    if any(t is not None for t in texts):
        message = F.coalesce(chosen([F.lit(None).cast("string") if t is None else t for t in texts]), message)
    cols = {"rule": listed([r.name for r in rules]), "field": listed([r.field for r in rules]), "value": chosen(values),
            "severity": listed([r.severity for r in rules]), "code": listed([r.code for r in rules]), "message": message,
            "suggestion": listed([r.suggestion for r in rules])}
    return each.select(*[F.col(quote(k)) for k in key], *[cols[f].alias(f) for f in ISSUE_FIELDS])


def empty_issues(spark: SparkSession, key_schema: T.StructType | None = None) -> DataFrame:
    fields = list(key_schema.fields) if key_schema else []
    fields += [T.StructField(f, T.StringType()) for f in ISSUE_FIELDS]
    return spark.createDataFrame([], T.StructType(fields))


# ---- rule builders (VAL-1, VAL-3, VAL-4, VAL-5, VAL-7, VAL-8) -------------

def _c(field: str) -> Column:
    return as_col(field)


def required(field: str, code: str = "MISSING_REQUIRED", allow_empty: bool = True,
             severity: str = "error", suggestion: str | None = None) -> Rule:
    """VAL-1 (present and not NULL; '' satisfies it) or, with
    ``allow_empty=False``, VAL-3 style (falsy fails)."""
    p = _c(field).isNull() if allow_empty else (_c(field).isNull() | (_c(field).cast("string") == ""))
    return Rule(f"required:{field}", field, p, severity, code, "is required", suggestion)


def min_length(field: str, n: int, code: str = "INVALID_LENGTH", severity: str = "error",
               suggestion: str | None = None) -> Rule:
    """VAL-3: a non-empty value shorter than ``n`` characters."""
    c = _c(field)
    p = (F.coalesce(c, F.lit("")) != "") & (F.length(c) < n)
    return Rule(f"min_length:{field}", field, p, severity, code,
                f"must be at least {n} characters long", suggestion)


def matches(field: str, pattern: str, code: str = "INVALID_FORMAT", severity: str = "error",
            message: str = "contains invalid characters", suggestion: str | None = None) -> Rule:
    """VAL-3 / VAL-8: a non-empty value that does not match ``pattern``
    (anchored at the start, as Python ``re.match``)."""
    c = _c(field)
    anchored = pattern if pattern.startswith("^") else "^(?:" + pattern + ")"
    p = (F.coalesce(c.cast("string"), F.lit("")) != "") & ~c.cast("string").rlike(anchored)
    return Rule(f"matches:{field}", field, p, severity, code, message, suggestion)


def not_in(field: str, values: Sequence, code: str = "COMMON_VALUE", severity: str = "warning",
           message: str = "appears to be a common default") -> Rule:
    """VAL-3: value is one of a forbidden list."""
    return Rule(f"not_in:{field}", field, _c(field).isin(*values), severity, code, message)


def allowed(field: str, values: Sequence, code: str = "UNSUPPORTED_VALUE",
            message: str = "unsupported value", suggestion: str | None = None) -> Rule:
    """VAL-7: value must be one of ``values``."""
    p = ~F.coalesce(_c(field).isin(*values), F.lit(False))
    sug = suggestion or ("Use one of: " + ", ".join(sorted(map(str, values))))
    return Rule(f"allowed:{field}", field, p, "error", code, message, sug)


def int_tiers(field: str, low: int | None = 1, warn_above: Sequence[tuple[int, str]] = (),
              code_prefix: str = "INVALID", warn_below: Sequence[tuple[int, str]] = (),
              integral: bool = False) -> list[Rule]:
    """VAL-5 / VAL-7: the value must parse as an integer (error), be at least
    ``low`` (error); then the first matching warning tier applies
    (``warn_above`` checked from the largest threshold down, ``warn_below``
    from the smallest up). A NULL value is not checked. ``integral=True``
    declares the column already holds integers (no text parse, no format
    rule)."""
    c = _c(field)
    present = c.isNotNull()
    if integral:
        n = c.cast("bigint")
        out = []
    else:
        n = F.trim(c.cast("string")).try_cast("bigint")
        out = [Rule(f"int:{field}", field, present & n.isNull(), "error",
                    f"{code_prefix}_{field.upper()}_FORMAT", "must be a number")]
    ok = present & n.isNotNull()
    if low is not None:
        out.append(Rule(f"min:{field}", field, ok & (n < low), "error", f"{code_prefix}_{field.upper()}",
                        f"must be at least {low}"))
        ok = ok & (n >= low)
    taken = F.lit(False)
    for thr, msg in sorted(warn_above, key=lambda t: -t[0]):
        cond = ok & (n > thr) & ~taken
        out.append(Rule(f"above:{field}:{thr}", field, cond, "warning", None,
                        F.format_string(msg, n)))
        taken = taken | (n > thr)
    for thr, msg in sorted(warn_below, key=lambda t: t[0]):
        cond = ok & (n < thr) & ~taken
        out.append(Rule(f"below:{field}:{thr}", field, cond, "warning", None, F.format_string(msg, n)))
        taken = taken | (n < thr)
    return out


def fits_bigint(field: str, pattern: str = r"^\s*([+-]?[0-9]+)\s*$", severity: str = "error") -> Rule:
    """FN-6 / FN-8 / FN-14: digits (group 1 of ``pattern``) that are past
    BIGINT, which the parsing functions give as 0 or NULL; the issue carries
    the text, so the number is not lost."""
    digits = F.regexp_extract(F.coalesce(_c(field).cast("string"), F.lit("")), pattern, 1)
    return Rule(f"bigint:{field}", field, (digits != "") & digits.try_cast("bigint").isNull(), severity, "NUMBER_TOO_LARGE",
                F.format_string("%d digits are past the range of a 64-bit number", F.length(F.regexp_replace(digits, "^[+-]?0*", ""))))


# Python urlparse: a scheme is a letter followed by letters, digits, + - . and
# a colon; the network location follows "//".
_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_parts(c) -> Column:
    """``struct(scheme, netloc, port)`` with ``urlparse`` rules (scheme
    lower-cased; '' when absent)."""
    c = as_col(c)
    scheme = F.lower(F.regexp_extract(c, _SCHEME_RE, 1))
    netloc = F.regexp_extract(c, _NETLOC_RE, 1)
    port = F.regexp_extract(netloc, r":([0-9]+)$", 1)
    return F.struct(scheme.alias("scheme"), netloc.alias("netloc"), port.alias("port"))


def url_rules(field: str, path_suffix: str | None = None) -> list[Rule]:
    """VAL-4: required; scheme present; host present; scheme http/https;
    optional expected path suffix (warning); localhost without port (warning)."""
    c = _c(field)
    u = url_parts(c)
    present = F.coalesce(c, F.lit("")) != ""
    rules = [
        Rule(f"url_required:{field}", field, ~present, "error", "MISSING_BASE_URL", "is required"),
        Rule(f"url_scheme:{field}", field, present & (u["scheme"] == ""), "error", "MISSING_PROTOCOL",
             "has no scheme", "start the address with http:// or https://"),
        Rule(f"url_host:{field}", field, present & (u["netloc"] == ""), "error", "MISSING_HOSTNAME",
             "names no host"),
        Rule(f"url_protocol:{field}", field, present & ~u["scheme"].isin("http", "https"), "error",
             "INVALID_PROTOCOL", F.format_string("scheme %s is not served", u["scheme"]),
             "only http and https are"),
        Rule(f"url_localhost:{field}", field, present & u["netloc"].contains("localhost") & (u["port"] == ""),
             "warning", None, "points at localhost and gives no port"),
    ]
    if path_suffix:
        stripped = F.regexp_replace(c, "/+$", "")
        rules.append(Rule(f"url_path:{field}", field, present & ~stripped.endswith(path_suffix.rstrip("/")),
                          "warning", None, f"does not end in {path_suffix}, as these addresses do"))
    return rules


def pattern_list_issues(spark: SparkSession, patterns, field: str = "exclusion_patterns") -> DataFrame:
    """VAL-8 / FLT-6: a pattern list must be a list of compilable regexes;
    each bad one becomes an issue row (driver-side configuration check)."""
    from .filters import check_patterns
    rows = []
    if not isinstance(patterns, (list, tuple)):
        rows.append((f"type:{field}", field, type(patterns).__name__, "error",
                     "INVALID_EXCLUSION_PATTERNS_TYPE", "is no list of patterns",
                     "give the patterns as a list of texts"))
    else:
        for chk in check_patterns(spark, patterns):
            if not chk.valid:
                rows.append((f"regex:{field}", f"{field}[{chk.index}]", str(chk.pattern), "error",
                             "INVALID_REGEX_PATTERN", chk.error, "see the message for the place of the fault"))
    return spark.createDataFrame(rows, T.StructType([T.StructField(f, T.StringType()) for f in ISSUE_FIELDS]))


# ---- VAL-2: configuration records in a JSON column -----------------------

# Accepted VARIANT types per declared type; Python's bool is an
# int, so booleans pass integer and number.
_TYPE_OK = {
    "string": ("STRING",),
    "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN"),
    "number": ("BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN", "DOUBLE", "FLOAT", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def config_rules(json_col: str, required_keys: Sequence[str] = (), deprecated: Sequence[str] = (),
                 properties: dict | None = None, version: str = "") -> list[Rule]:
    """VAL-2: required keys present, deprecated keys warned, declared types
    checked (``schema_of_variant``); unknown type names pass."""
    v = F.try_parse_json(F.col(quote(json_col)))
    out = []
    for k in required_keys:
        out.append(Rule(f"config_required:{k}", k, F.try_variant_get(v, f"$.{k}", "variant").isNull(),
                        "error", "MISSING_FIELD", f"Required field missing: {k}", value=F.lit(None)))
    for k in deprecated:
        out.append(Rule(f"config_deprecated:{k}", k, F.try_variant_get(v, f"$.{k}", "variant").isNotNull(),
                        "warning", "DEPRECATED_FIELD", f"Field '{k}' is deprecated in version {version}",
                        value=F.lit(None)))
    for k, spec in (properties or {}).items():
        t = spec.get("type")
        if t not in _TYPE_OK:
            continue
        sub = F.try_variant_get(v, f"$.{k}", "variant")
        kind = F.regexp_extract(F.schema_of_variant(sub), r"^([A-Z]+)", 1)
        bad = sub.isNotNull() & ~kind.isin(*_TYPE_OK[t])
        out.append(Rule(f"config_type:{k}", k, bad, "error", "INVALID_TYPE",
                        F.format_string(f"Field '{k}' has incorrect type. Expected: {t}, got: %s", F.lower(kind)),
                        value=F.to_json(sub)))
    return out


# ---- VAL-6 / VAL-14 / AGG-11 ---------------------------------------------

IssueSource = Callable[[DataFrame], DataFrame]


def _stored(issues: DataFrame) -> DataFrame:
    """Run a rule's job now and read its issues back."""
    spark = issues.sparkSession
    path = scratch_path(spark, f"issues-{uuid.uuid4().hex}")
    issues.write.parquet(path)
    return spark.read.schema(issues.schema).parquet(path)


def run_rules(df: DataFrame, rules: Sequence[Rule], key: Sequence[str],
              custom: dict[str, IssueSource] | None = None) -> DataFrame:
    """VAL-14: built-in rules (fused) then custom rule functions (UDF-2:
    ``DataFrame -> issues DataFrame``), unioned (VAL-6).

    Every part runs as a job of its own, whose issues are stored: a rule that
    fails, while its plan is built or while it runs, becomes one
    RULE_EXECUTION_ERROR issue, and the others go on. If the fused job fails,
    each rule is tried alone once, and those that work are fused again."""
    spark = df.sparkSession
    key_schema = df.select(*[quote(k) for k in key]).schema
    columns = T.StructType(list(key_schema.fields) + [T.StructField(f, T.StringType()) for f in ISSUE_FIELDS])
    parts: list[DataFrame] = []

    def failed(name: str, e: Exception) -> None:
        told = next((line for line in str(e).splitlines() if line.strip()), type(e).__name__)
        row = [None] * len(key_schema.fields) + [name, None, None, "error", "RULE_EXECUTION_ERROR", f"Validation rule '{name}' failed: {told}", None]
        parts.append(spark.createDataFrame([tuple(row)], columns))

    rules = list(rules)
    if rules:
        try:
            parts.append(_stored(validate(df, rules, key)))
        except Exception:  # noqa: BLE001 — which rule it was is found out next
            works = []
            for r in rules:
                try:
                    validate(df, [r], key).write.format("noop").mode("overwrite").save()
                    works.append(r)
                except Exception as e:  # noqa: BLE001 — a rule failure is data
                    failed(r.name, e)
            if works:
                parts.append(_stored(validate(df, works, key)))
    for name, fn in (custom or {}).items():
        try:
            parts.append(_stored(fn(df)))
        except Exception as e:  # noqa: BLE001 — a rule failure is data
            failed(name, e)
    if not parts:
        return empty_issues(spark, key_schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def count_issues(df: DataFrame, rules: Sequence[Rule], group: Sequence[str] = ()) -> DataFrame:
    """AGG-11 without issue rows: per severity the number of (row, rule)
    issues, counted straight from the rule predicates in one partial
    aggregate (no explode). Same counts as ``issue_summary(validate(...))``;
    combine several with ``sum_counts``."""
    cols = []
    for sev in SEVERITIES:
        parts = [F.count_if(F.coalesce(r.predicate, F.lit(False))) for r in rules if r.severity == sev]
        c = reduce(lambda a, b: a + b, parts) if parts else F.lit(0)
        cols.append(c.cast("bigint").alias(f"{sev}_count"))
    return df.groupBy(*group).agg(*cols)


def sum_counts(counts: Sequence[DataFrame], group: Sequence[str] = ()) -> DataFrame:
    """Add up per-severity counts (from ``count_issues`` or
    ``issue_summary``) and derive the total and ``valid``."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
               [c.select(*group, *[f"{s}_count" for s in SEVERITIES]) for c in counts])
    tot = u.groupBy(*group).agg(*[F.sum(f"{s}_count").cast("bigint").alias(f"{s}_count") for s in SEVERITIES])
    total = reduce(lambda a, b: a + b, [F.col(f"{s}_count") for s in SEVERITIES])
    return tot.select(*group, total.cast("bigint").alias("total_issues"), *[f"{s}_count" for s in SEVERITIES],
                      ((F.col("error_count") + F.col("critical_count")) == 0).alias("valid"))


def issue_summary(issues: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AGG-11 / VAL-6: counts per severity, total, and ``valid`` (no error or
    critical issue). One partial aggregate."""
    sev = F.col("severity")
    return issues.groupBy(*group).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_issues"),
        *[F.count_if(sev == s).cast("bigint").alias(f"{s}_count") for s in SEVERITIES],
        (F.count_if(sev.isin(*BLOCKING)) == 0).alias("valid"),
    )
