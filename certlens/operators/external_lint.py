"""External linter results -> findings.

Input: (cert_hash, result_json) where result_json is the linter's JSON output:
``{"results": {name: result}}`` or ``{name: result}``; a result is an object
with ``result``/``status``, ``details``/``detail`` and ``source``, or a bare
status string. Passing / not-applicable statuses are dropped; the rest
become findings ``ZLINT_<NAME>`` with a mapped severity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.config import EXTERNAL_LINT_NON_FINDINGS, EXTERNAL_LINT_SEVERITY
from certlens.functions.timewin import ts_lit

MAP = "map<string,string>"
RESULT = "struct<result:string,status:string,details:string,detail:string,source:string>"


def finding_code(name: Column) -> Column:
    """'ZLINT_' + upper-cased name with every non-alphanumeric char -> '_'."""
    return F.concat(F.lit("ZLINT_"), F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]", "_"))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def severity(status: Column) -> Column:
    expr = F.lit("low")
    for key, sev in reversed(list(EXTERNAL_LINT_SEVERITY.items())):
        expr = F.when(status == key, F.lit(sev)).otherwise(expr)
    return expr


def external_lint_findings(results: DataFrame, created_at=None, linter_version: str = "unknown") -> DataFrame:
    # Each JSON text is parsed once, in its own projection.
    rooted = results.select("cert_hash", F.from_json(F.col("result_json"), MAP).alias("root"))
    nested = rooted.select("cert_hash", "root", F.from_json(F.col("root").getItem("results"), MAP).alias("nested"))
    # a "results" that is null or no object holds nothing; only without the key is the whole object taken
    inner = F.when(F.map_contains_key("root", "results"), F.col("nested")).otherwise(F.col("root"))
    rows = nested.select("cert_hash", F.explode(inner).alias("lint_name", "raw"))
    # Each result is parsed once into a struct (NULL for a bare status string).
    rows = rows.withColumn("o", F.when(F.ltrim(F.col("raw")).startswith("{"), F.from_json("raw", RESULT)))
    o = F.col("o")
    status = F.lower(F.when(o.isNotNull(), F.coalesce(_nonempty(o["result"]), _nonempty(o["status"]), F.lit("")))
                     .otherwise(F.coalesce(F.col("raw"), F.lit(""))))
    details = F.when(o.isNotNull(), F.coalesce(_nonempty(o["details"]), _nonempty(o["detail"]), F.lit(""))) \
        .otherwise(F.lit(""))
    source = o["source"]
    parsed = rows.select("cert_hash", "lint_name", status.alias("status"), details.alias("details"),
                         source.alias("source"))
    kept = parsed.filter((F.col("status") != "") & ~F.col("status").isin(*EXTERNAL_LINT_NON_FINDINGS))
    evidence = F.to_json(F.struct(F.col("details"), F.col("source"), F.col("lint_name").alias("zlint_name"),
                                  F.col("status").alias("zlint_result"), F.lit(linter_version).alias("zlint_version")),
                         {"ignoreNullFields": "false"})
    stamp = ts_lit(created_at) if created_at is not None else F.current_timestamp()
    return kept.select("cert_hash", finding_code(F.col("lint_name")).alias("finding_code"),
                       severity(F.col("status")).alias("severity"), evidence.alias("evidence_json"),
                       stamp.alias("created_at"))
