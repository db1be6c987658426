"""Public-suffix rules as a small table, and registered-domain (eTLD+1)
computation as a broadcast join instead of a per-row library call.

Rules follow the public suffix list format: ``com`` (normal), ``*.ck``
(wildcard), ``!www.ck`` (exception). A built-in subset is provided; load
the complete public list with ``load_rules(path)`` for production.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlens.functions.hostnames import normalize_hostname, strip_wildcard

# --------------------------------------------------------------------------
# A test fixture, a subset of the public suffix list (ICANN section
# plus a few private-section entries), one rule per entry, list order. Jobs get
# the whole list as a file; nothing falls back to these.
# --------------------------------------------------------------------------
FIXTURE_RULES = """
com net org edu gov mil int info biz name pro mobi asia tel travel jobs aero coop museum
io co ai app dev me tv cc ws us eu uk de fr nl be ch at it es pt se no dk fi pl cz sk hu ro bg gr ie
ru ua by kz cn jp kr in au nz ca mx br ar cl pe za ng ke eg tr il ae sa ir pk id my sg th vn ph hk tw
co.uk org.uk ac.uk gov.uk ltd.uk plc.uk me.uk net.uk sch.uk nhs.uk police.uk
com.au net.au org.au edu.au gov.au asn.au id.au
co.jp ne.jp or.jp ac.jp go.jp ad.jp ed.jp gr.jp lg.jp
com.br net.br org.br gov.br edu.br
co.nz net.nz org.nz govt.nz ac.nz
com.cn net.cn org.cn gov.cn edu.cn ac.cn
co.in net.in org.in gov.in ac.in firm.in gen.in ind.in
com.mx org.mx gob.mx edu.mx net.mx
co.za org.za gov.za ac.za net.za
com.tr org.tr gov.tr edu.tr net.tr
com.sg org.sg gov.sg edu.sg net.sg
com.hk org.hk gov.hk edu.hk net.hk
co.kr or.kr go.kr ac.kr ne.kr
com.tw org.tw gov.tw edu.tw net.tw
com.ar com.pe com.ph com.my com.vn com.pk com.eg com.ng com.ua com.ru co.il org.il ac.il co.id or.id ac.id
*.ck !www.ck *.bd *.er *.fk *.jm *.kh *.mm *.np *.pg
*.kawasaki.jp !city.kawasaki.jp *.kobe.jp !city.kobe.jp
blogspot.com github.io githubusercontent.com herokuapp.com appspot.com cloudfront.net
azurewebsites.net s3.amazonaws.com *.compute.amazonaws.com netlify.app vercel.app pages.dev
""".split()


def parse_rules(lines) -> list[str]:
    """Rules from public-suffix-list text (comments and blanks skipped; the
    first white-space separated token of a line is the rule)."""
    out = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("//"):
            continue
        out.append(line.split()[0].lower())
    return out


def load_rules(spark: SparkSession, path: str) -> list[str]:
    """The rules of a public suffix list file, read by Spark from any store. The
    list is a published one of some ten thousand lines."""
    rules = parse_rules(row.value for row in spark.read.text(path).toLocalIterator())
    if not rules:
        raise ValueError(f"no suffix rules in {path}")
    return rules


def rules_frame(spark: SparkSession, rules: list[str]) -> DataFrame:
    """(suffix, kind, n_labels): kind is normal / wildcard / exception; for a
    wildcard ``*.x`` the suffix is ``x``, for an exception ``!a.x`` it is ``a.x``."""
    rows = []
    for rule in rules:
        if rule.startswith("!"):
            rows.append((rule[1:], "exception"))
        elif rule.startswith("*."):
            rows.append((rule[2:], "wildcard"))
        else:
            rows.append((rule, "normal"))
    return spark.createDataFrame(rows, "suffix string, kind string")


def _domain_value(host) -> F.Column:
    """Registered-domain input form: normalised, one leading '*.' removed."""
    return strip_wildcard(normalize_hostname(host))


def registered_domain_table(hosts: DataFrame, rules: DataFrame, host_col: str = "host",
                            n_rules: int | None = None) -> DataFrame:
    """Distinct hosts -> (host, registered_domain).

    Every distinct host is expanded into its label suffixes (a handful of
    rows) and left-joined to the rule table (broadcast when ``n_rules`` says
    that it comes from a driver-side list); the longest matching rule is chosen per host in an
    aggregate on the same key the ``distinct`` already partitioned by, so
    the whole chain costs one shuffle. An exception rule wins and yields its
    suffix minus one label; otherwise the longest normal or wildcard (+1
    label) match, with the implicit ``*`` rule (the last label) as default.
    The registered domain is one label more than the public suffix, or the
    host itself when it has no label beyond it.
    """
    d = hosts.select(F.col(host_col).alias("host")).where(F.col("host").isNotNull()).distinct()
    v = F.regexp_replace(_domain_value(F.col("host")), r"^\.+", "")
    base = d.select("host", v.alias("v")).withColumn("labels", F.split("v", r"\."))
    base = base.withColumn("n", F.when(F.col("v") == "", F.lit(0)).otherwise(F.size("labels")))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))),
                           lambda i: F.array_join(F.slice("labels", i, F.col("n") - i + 1), "."))
    cand = base.select("host", "v", "n", F.posexplode_outer(
        F.when(F.col("n") > 0, suffixes).otherwise(F.array().cast("array<string>"))).alias("pos", "suffix"))
    cand = cand.withColumn("k", F.col("n") - F.col("pos"))
    r = F.broadcast(rules) if n_rules is not None else rules
    per_host = cand.join(r, "suffix", "left").groupBy("host").agg(
        F.max("v").alias("v"), F.max("n").alias("n"),
        F.max(F.when(F.col("kind") == "exception", F.col("k"))).alias("exc_k"),
        F.max(F.when(F.col("kind") == "normal", F.col("k"))).alias("norm_k"),
        F.max(F.when((F.col("kind") == "wildcard") & (F.col("k") < F.col("n")), F.col("k") + 1)).alias("wild_k"))
    ps_len = F.when(F.col("exc_k").isNotNull(), F.col("exc_k") - 1).otherwise(
        F.greatest(F.coalesce("norm_k", F.lit(0)), F.coalesce("wild_k", F.lit(0)), F.lit(1)))
    take = F.least(ps_len + 1, F.col("n"))
    labels = F.split("v", r"\.")
    reg = F.array_join(F.slice(labels, F.col("n") - take + 1, take), ".")
    return per_host.select("host", F.when(F.col("v") == "", F.lit("")).otherwise(reg).alias("registered_domain"))


def with_registered_domain(df: DataFrame, host_col: str, out_col: str, rules: DataFrame,
                           n_rules: int | None = None) -> DataFrame:
    """Add ``out_col`` to ``df`` by joining the per-distinct-host result back."""
    table = registered_domain_table(df, rules, host_col, n_rules).withColumnRenamed("host", "_h")
    return (df.join(table, df[host_col] == table["_h"], "left").drop("_h")
            .withColumnRenamed("registered_domain", out_col))
