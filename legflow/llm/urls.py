"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes.

A rule is a host and a path prefix with a verdict.  It fits its host and all
subdomains, where the url's path starts with the rule's.  A url is expanded
into expressions, each a suffix of its host (whole labels) with a prefix of
its path.  Only shapes (labels, path length) that some rule has are expanded,
so neither long hosts nor long paths multiply rows beyond the number of
different rule shapes.  An expression's sha256 begins with the short prefix
that rules are equi-joined on; the full digest then confirms the rule.

Precedence: the longest rule (host and path together) wins, then the longer
host, then block over allow, then the smaller text.  A url that no rule fits
is allowed.

The rules of a url follow from its host and path alone, so pages are first
reduced to distinct (host, path) pairs; a host or url that a third of all
pages share is expanded once, and the pages join the few matched pairs again.
DataFrame functions only.

Nulls: a null url, or one without ``://``, has an empty host and path, which
no rule fits.  A null page id is kept.  Repeated rows are judged each; a text
of any length is a url.  Null, host-less and repeated rules are left out.
Without rules every url is allowed; without pages the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legflow.llm.shared import cut

#: Hexadecimal digits of the short prefix (4 bytes).
SHORT = 8
#: Rules (about 100 bytes each) that a join may send to every executor.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, verdict, host_labels, path_length, digest, short) of distinct rules (rule, verdict)."""
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    at = F.instr("rule", "/")
    path = F.when(at > 0, F.substr("rule", at)).otherwise("")
    digest = F.sha2(F.concat(host, path), 256)
    return (rules.select("rule", "verdict").filter("rule is not null and verdict in ('allow', 'block')").distinct()
            .select("rule", "verdict", host.alias("rule_host"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("path_length"),
                    digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"))
            .filter("rule_host <> ''"))


def expressions(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``urls`` (host, path) with one row for each expression of a shape that fits, as ``expression`` (its digest)."""
    by_labels: dict[int, list[int]] = {}
    for labels, length in shapes:
        by_labels.setdefault(labels, []).append(length)
    # the suffix of a number of labels is cut once, whatever the number of path lengths that go with it
    options = F.array(*[F.struct(F.lit(n).alias("labels"), F.substring_index("host", ".", -n).alias("suffix"),
                                 F.array(*[F.lit(x) for x in sorted(lengths)]).alias("lengths")) for n, lengths in sorted(by_labels.items())])
    labels = F.size(F.split("host", r"\."))
    suffixes = F.filter(options, lambda o: o["labels"] <= labels)
    wide = urls.select("host", "path", F.explode(suffixes).alias("o"))
    fitting = F.filter(F.col("o.lengths"), lambda x: x <= F.length("path"))
    wide = wide.select("host", "path", F.col("o.suffix").alias("suffix"), F.explode(fitting).alias("n"))
    return wide.select("host", "path", F.sha2(F.concat("suffix", F.substr("path", F.lit(1), F.col("n"))), 256).alias("expression"))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct ``urls`` (host, path) that some rule fits: the winning one."""
    table = cut(rule_table(rules))
    # one row for each pair of label count and path length that occurs among rules, bounded by the lengths of a rule
    shapes = [(r.labels, r.path_length) for r in table.select("labels", "path_length").distinct().collect()]
    if not shapes:
        return urls.limit(0).select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    sent = F.broadcast(table) if table.count() <= BROADCAST_RULES else table
    found = (expressions(urls, shapes).withColumn("short", F.substring("expression", 1, SHORT))
             .join(sent, "short").filter("expression = digest"))
    rank = F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), (F.col("verdict") == "block").alias("c"), F.col("rule").alias("rule"),
                    F.col("verdict").alias("verdict"))
    return found.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (columns ``keep``; all if None) with host, path, rule and verdict appended; columns of those names are replaced."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*[F.col(c) for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    best = matches(rows.filter("host <> ''").select("host", "path").distinct(), rules)
    return (rows.join(best, ["host", "path"], "left")
            .select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose url is not blocked, with the columns of ``pages``."""
    clean = {c: f"__llm_{c}" for c in ("host", "path", "rule", "verdict") if c in pages.columns}
    rows = judge(pages.withColumnsRenamed(clean), rules, clean.get(url, url)).filter("verdict = 'allow'")
    return rows.select(*[F.col(clean.get(c, c)).alias(c) for c in pages.columns])
