"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests.

A rule is (host, path, verdict). It fits its host and all subdomains, if the URL's path starts with the rule's. The
longest fitting rule (host and path together) wins; among equally long ones the longer host, then ``block``. URLs that no
rule fits get the default verdict.

A rule's path is looked up by its part up to the last ``/``, so that expressions are made only at slashes; the rest of
the path is confirmed after the join. URLs are expanded no deeper than the rules go (dots of hosts, slashes of paths).

Defined cases: null URLs and those without ``://`` have an empty host and path. Null hosts or paths of rules count as
empty; a rule with an empty host fits only empty hosts; rules whose verdict is null are ignored. Repeated URLs are judged once. No rules: the
default. Extra columns pass through; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logmeld.llm.common import LOWER, UPPER, fresh, written


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _cut(path: Column) -> Column:
    """Up to the last slash, itself included."""
    return F.regexp_extract(path, r"^(?s:.*)/", 0)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _dots(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))


def expressions(host: Column, path: Column, dots: int, slashes: int) -> Column:
    """Array of (host suffix, path prefix): up to `dots` dots in the suffix, up to `slashes` slashes in the prefix.

    The whole host, if deeper, comes last among the suffixes, and the empty prefix first among the prefixes.
    """
    labels = F.sequence(F.lit(1), F.lit(dots + 1))
    hosts = F.array_distinct(F.transform(labels, lambda k: F.call_function("substring_index", host, F.lit("."), -k)))
    paths = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.lit(slashes)), lambda k: _cut_at(path, k))) if slashes else F.array(F.lit("")))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))


def _cut_at(path: Column, k: Column) -> Column:
    """Up to the k-th slash, or all up to the last one."""
    head = F.call_function("substring_index", path, F.lit("/"), k)
    return F.when(head == path, _cut(path)).otherwise(F.concat(head, F.lit("/")))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """``df`` with host, path, rule (null where none fits) and verdict.

    Rules are distinct and their expressions joined to those of distinct (host, path) pairs; Spark broadcasts the rules
    where they are small. What fits is written to the shared folder and joined back by (host, path), so a hot URL is split.
    """
    rules = rules.select(
        F.coalesce(F.translate("host", UPPER, LOWER), F.lit("")).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"),
    ).filter("r_verdict is not null").distinct()
    depth = rules.agg(F.max(_dots(F.col("r_host"))), F.max(_slashes(F.col("r_path")))).first()
    rules = rules.withColumn("full", _digest(F.col("r_host"), _cut(F.col("r_path"))))
    rules = rules.withColumn("short", F.substring("full", 1, prefix_chars))

    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    host, path = host_path(F.col(f"`{url}`"))
    df = df.withColumn("host", host).withColumn("path", path)
    asked = (
        df.select("host", "path").distinct()
        .withColumn("e", F.explode(expressions(F.col("host"), F.col("path"), int(depth[0] or 0), int(depth[1] or 0))))
        .withColumn("full_", _digest(F.col("e.h"), F.col("e.p")))
        .withColumn("short", F.substring("full_", 1, prefix_chars))
    )
    fits = (
        asked.join(rules, "short")
        .filter((F.col("full") == F.col("full_")) & (F.col("e.h") == F.col("r_host")) & F.startswith("path", "r_path"))
    )
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
        (F.col("r_verdict") == "block").alias("blocks"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )).alias("best")).select("host", "path", "best.rule", "best.verdict")
    best = written(best, "url-rules")
    return df.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(
        *[F.col(f"`{c}`") for c in df.columns], "rule", "verdict")
