"""URL filters: explicit rules first, then a tree of path templates per host. DataFrame functions only.

A path's segments have their runs of digits generalised, and equal paths are counted once per host before anything
else, so a host with very many pages has as many rows as it has kinds of paths. From the root on, a segment keeps its
own branch if its labelled share of bad pages differs from its parent's, as a normal test tells, however many siblings
it has. All others become the wildcard `*`: those that are like their parent, and those with so few labelled pages that
on their own they would get their host's verdict whatever their labels. A template's share of good pages is smoothed
with its host's and that with all pages'; templates that are not pure enough are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Block or allow a host and its subdomains, where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class Tree:
    """How templates are made and judged."""

    depth: int = 6  # the last level holds whatever is left of a path
    alike: float = 1.96  # standard errors within which a branch is like its parent
    smoothing: float = 10.0  # pages that a parent's share counts for
    purity: float = 0.5  # smoothed share of good pages below which a template is rejected


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        name = F.when(rule.fits(host, path), rule.name).otherwise(name)
        verdict = F.when(rule.fits(host, path), rule.verdict).otherwise(verdict)
    return name, verdict


def template(path: Column, depth: int) -> list[Column]:
    """A path's segments with their digits generalised, `depth` of them; empty where the path is shorter."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")
    first = [F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")) for i in range(1, depth)]
    return [*first, F.array_join(F.slice(parts, depth, F.greatest(F.size(parts), F.lit(1))), "/")]


def judged(pages: DataFrame, tree: Tree) -> DataFrame:
    """host, kind, template, labelled (pages of the template that have a label), purity (its smoothed share of good
    pages) and rejected for each kind of path; `pages` has host, path, bad (1, 0, or null without a label)."""
    levels = [f"t{i}" for i in range(tree.depth)]
    kinds = pages.select("host", "bad", *(c.alias(t) for c, t in zip(template(F.col("path"), tree.depth), levels)))
    kinds = kinds.withColumn("kind", F.concat_ws("/", *levels))
    nodes = kinds.groupBy("host", "kind", *levels).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    # a row per host and kind of path is little; as a table of its own it keeps every level's plan short
    nodes = staged(nodes, "kinds")
    used = nodes.agg(*(F.max(F.col(t) != "").alias(t) for t in levels)).first()
    m = tree.smoothing
    hosts = nodes.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    everything = hosts.agg(F.sum("hn").alias("an"), F.sum("hb").alias("ab"))  # one row
    prior = F.coalesce(F.col("ab") / F.nullif(F.col("an"), F.lit(0)), F.lit(0.0))
    hosts = hosts.crossJoin(F.broadcast(everything)).select("host", ((F.col("hb") + m * prior) / (F.col("hn") + m)).alias("by_host"))
    hosts = staged(hosts, "hosts")

    def purity(bad: Column, n: Column) -> Column:
        return 1 - (bad + m * F.col("by_host")) / (n + m)

    def rejected(bad: Column, n: Column) -> Column:
        return purity(bad, n) < tree.purity

    for i, level in enumerate(levels):
        if not used[level]:
            break
        above = ["host", *levels[:i]]
        branch = nodes.groupBy(*above, level).agg(F.sum("n").alias("bn"), F.sum("b").alias("bb"))
        parent = branch.groupBy(*above).agg(F.sum("bn").alias("pn"), F.sum("bb").alias("pb")).join(hosts, "host")
        share, own = F.col("pb") / F.col("pn"), F.col("bb") / F.col("bn")
        error = F.sqrt(share * (1 - share) / F.col("bn"))
        alike = (F.col("pn") == 0) | (F.col("bn") == 0) | (F.abs(own - share) <= tree.alike * error)
        rare = rejected(F.col("bn"), F.col("bn")) == rejected(F.lit(0), F.col("bn"))
        ended = F.col(level) == ""
        new = F.when(alike | rare, "*").otherwise(F.col(level))
        # a branch's new name, found by the branch and put on all kinds below it
        named = branch.join(parent, above).select(*above, level, F.when(ended, "").otherwise(new).alias("new"))
        nodes = staged(nodes.join(named, [*above, level]).drop(level).withColumnRenamed("new", level), "kinds")
    leaf = nodes.groupBy("host", *levels).agg(F.sum("n").alias("labelled"), F.sum("b").alias("lb"))
    leaf = leaf.join(hosts, "host").withColumn("purity", purity(F.col("lb"), F.col("labelled"))).withColumn("rejected", F.col("purity") < tree.purity)
    shown = F.concat(F.lit("/"), F.array_join(F.filter(F.array(*levels), lambda x: x != ""), "/"))
    return nodes.join(leaf, ["host", *levels]).select("host", "kind", shown.alias("template"), "labelled", "purity", "rejected")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], tree: Tree = Tree()) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url), and its path's template with the
    number of its labelled pages and its purity, by which the method decides.

    `labels` (page_id, bad: 1 or 0) need not cover all pages; rows with nulls are left out and the largest of several
    labels of a page counts. The longest rule that fits decides; else a page is blocked if its path's template is
    rejected. A null URL, or one without `://`, has an empty host and path, which may be rejected like any other.
    Repeated rows are judged each, and rows with a null page_id have no label. Without labels nothing is rejected.
    """
    host, path = parsed(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    told = judged(placed.join(marks, "page_id", "left"), tree)
    kind = F.concat_ws("/", *template(F.col("path"), tree.depth))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    found = placed.withColumn("kind", kind).join(told, ["host", "kind"])
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "labelled", "purity")
