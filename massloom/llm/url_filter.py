"""URL verdicts by fixed rules, else by a per-host tree of path templates with labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.staging import release, stage

#: A path segment stays literal if it has at least this share of its parent's urls (and so often at least); so a node has at most 1 / SHARE literal children.
SHARE, LEAST = 0.02, 5
#: Siblings merge if what follows them differs by less than this Jensen-Shannon divergence (in bits).
DIVERGENCE = 0.05
#: Pseudo-labels with which a template's purity is drawn to its host's, and a host's to all hosts'.
SMOOTHING = 5.0
#: Smoothed share of bad labels above which a template is rejected; one without labels never is.
REJECT_AT = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule string, its verdict) of the longest of the rules (verdict, host/path) that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """Kind of a segment, for comparing what follows two branches."""
    return (
        F.when(segment.isNull(), "end")
        .when(segment == "", "slash")
        .when(segment.rlike(r"^[0-9]+$"), "number")
        .when(segment.rlike(r"^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*$"), "code")
        .when(segment.rlike(r"\."), F.concat(F.lit("file."), F.regexp_extract(segment, r"\.([^.]{0,8})[^.]*$", 1)))
        .otherwise("word")
    )


def _merge_siblings(group: pd.DataFrame) -> pd.DataFrame:
    """Branch names of the literal children of one node: a child joins the largest earlier child that is followed alike."""
    wide = group.pivot_table(index="segment", columns="shape", values="n", aggfunc="sum", fill_value=0)
    wide = wide.loc[sorted(wide.index, key=lambda s: (-wide.loc[s].sum(), s))]
    heads: list[tuple[str, np.ndarray]] = []
    rows = []

    def entropy(p: np.ndarray) -> float:
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum())

    for segment, counts in wide.iterrows():
        n = counts.to_numpy(float)
        p = n / n.sum()
        for name, mass in heads:
            q = mass / mass.sum()
            w = n.sum() / (n.sum() + mass.sum())
            mid = w * p + (1 - w) * q
            # the bound widens by what sampling alone gives for so few urls
            if entropy(mid) - w * entropy(p) - (1 - w) * entropy(q) <= DIVERGENCE * min(1.0, 4 * w * (1 - w)) + (np.count_nonzero(mid) - 1) / (2 * np.log(2) * (n.sum() + mass.sum())):
                mass += n
                rows.append((segment, name))
                break
        else:
            heads.append((segment, n.copy()))
            rows.append((segment, segment))
    out = pd.DataFrame(rows, columns=["segment", "branch"])
    return out.assign(host=group["host"].iloc[0], node=group["node"].iloc[0])[["host", "node", "segment", "branch"]]


def templates(paths: DataFrame) -> DataFrame:
    """The template of each (host, path) of paths (host, path, n, distinct by host and path): columns host, path, template.

    From the root on: rare segments under a node become the wildcard *; the frequent ones
    stay literal, and those followed alike merge into one branch. Segments that all paths of
    a node have in common are taken in one step, and so is what is left below a node with too
    few urls for a literal; so a long path needs no more rounds than branches. All
    aggregations are over distinct paths with their counts, combined before the shuffle.
    """
    spark = paths.sparkSession
    parts = F.split(F.col("path"), "/")
    level, _ = stage(paths.select("host", "path", "n", F.slice(parts, 2, F.size(parts)).alias("rest"), F.lit("").alias("node")), "url-level")
    done = []
    while True:
        done.append(level.where(F.size("rest") == 0).select("host", "path", "node"))
        own = level.where(F.size("rest") > 0).withColumn("segment", F.get("rest", F.lit(0)))
        if own.isEmpty():
            break
        differ = F.array_position(F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        common = F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int")
        nodes = own.groupBy("host", "node").agg(F.sum("n").alias("total"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        nodes, nodes_path = stage(nodes.select("host", "node", "total", common.alias("common")), "url-nodes")
        # with a common segment, all of a node go the same way
        literal = own.groupBy("host", "node", "segment").agg(F.sum("n").alias("n")).join(nodes.where((F.col("total") >= LEAST) & (F.col("common") == 0)), ["host", "node"])
        literal, literal_path = stage(literal.where((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("total"))).select("host", "node", "segment"), "url-literal")
        following = own.join(literal, ["host", "node", "segment"]).groupBy("host", "node", "segment", _shape(F.get("rest", F.lit(1))).alias("shape")).agg(F.sum("n").alias("n"))
        branches = following.groupBy("host", "node").applyInPandas(_merge_siblings, "host string, node string, segment string, branch string")
        after = own.join(nodes, ["host", "node"]).join(branches, ["host", "node", "segment"], "left")
        step = F.when(F.col("total") < LEAST, F.size("rest")).otherwise(F.greatest("common", F.lit(1)))
        names = F.when(F.col("total") < LEAST, F.expr("repeat('/*', size(rest))")).when(F.col("common") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", 1, F.col("common")), "/"))).otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
        level, _ = stage(after.select("host", "path", "n", F.slice("rest", step + 1, F.size("rest")).alias("rest"), F.concat("node", names).alias("node")), "url-level")
        release(spark, nodes_path, literal_path)
    return reduce(DataFrame.unionByName, done).select("host", "path", F.col("node").alias("template"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Judge every row of pages (page_id, url) by rules, else by its path template's labelled purity.

    labels (page_id, bad 0/1) covers any part of the pages. Returns page_id, host, path, rule
    (the longest that fits, else null), verdict (allow or block), template, purity (smoothed
    share of labels that are not bad).

    Null urls and those without :// have an empty host and path, and so a template of their
    own. Repeated urls and ids are judged each; labels of a repeated page_id count for each of
    its rows; null ids have no label. Without labels all templates are allowed. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("marked"), F.sum(F.col("bad").cast("long")).alias("bad"))
    counted = rows.join(marks, "page_id", "left").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.coalesce("marked", F.lit(0))).alias("marked"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    counted, _ = stage(counted, "url-paths")
    known = templates(counted.select("host", "path", "n"))
    by_template = known.join(counted, ["host", "path"]).groupBy("host", "template").agg(F.sum("marked").alias("marked"), F.sum("bad").alias("bad"))
    by_host = by_template.groupBy("host").agg(F.sum("marked").alias("host_marked"), F.sum("bad").alias("host_bad"))
    overall = F.broadcast(counted.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.sum("marked"), F.lit(1))).alias("all_bad")))  # one row
    host_share = (F.col("host_bad") + SMOOTHING * F.col("all_bad")) / (F.col("host_marked") + SMOOTHING)
    bad = (F.col("bad") + SMOOTHING * host_share) / (F.col("marked") + SMOOTHING)
    judged = by_template.join(by_host, "host").crossJoin(overall).select("host", "template", "marked", (1 - bad).alias("purity"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("marked") > 0) & (F.col("purity") < 1 - REJECT_AT), "block").otherwise("allow")
    out = rows.join(known.join(judged, ["host", "template"]), ["host", "path"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
