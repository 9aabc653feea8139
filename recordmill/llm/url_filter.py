"""Verdicts on URLs: rules where one fits, and a tree of path templates learnt from them elsewhere.

The rules' verdicts are the labels. The path segments of each host make a tree (what lies behind the
seventh segment is one more, so whole paths count). A segment of digits or hexadecimal signs becomes
a wildcard at once. Then, level by level, labelled branches are merged into a wildcard where their share of
blocked labels does not differ significantly from their siblings', or where they have under ``SUPPORT`` rows.
Labels say nothing of a branch without any, so those stand apart, small ones together. A template's purity is the blocked share of its own labels on its own host,
smoothed with one half; templates from ``REJECT`` on are blocked, so one without labels never is.
Everything is aggregates and joins over templates.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.text import ascii_lower
from recordmill.plans.pins import pin

DEPTH = 8
SUPPORT = 5
Z = 1.96
SMOOTH = 5.0
REJECT = 0.7
LEVELS = [f"s{k}" for k in range(1, DEPTH + 1)]
MERGED, APART = "/?*", "/?"  # wildcards of labelled branches, and of small ones without labels; no path holds a question mark


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule that fits host (or a parent of it) and path; null where none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # a longer one overrides
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def segment(path: Column, k: int, last: bool = False) -> Column:
    """The path's ``k``-th segment (``last``: and all behind it) with runs of digits and long hexadecimal runs as ``*``."""
    parts = F.split(path, "/")
    part = F.array_join(F.slice(parts, k + 1, 1 << 30), "/") if last else F.try_element_at(parts, F.lit(k + 1))
    return F.regexp_replace(F.coalesce(part, F.lit("")), "[0-9a-f]{8,}|[0-9]+", "*")


def _counts() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def _generalised(tree: DataFrame, level: str) -> DataFrame:
    """``tree`` with its next level added to ``template``: the branch, or a wildcard where it is weak or like its siblings."""
    branch = tree.groupBy("host", "template", level).agg(*_counts())
    parent = branch.groupBy("host", "template").agg(*_counts()).select(
        "host", "template", *[F.col(c).alias(f"all_{c}") for c in ("labelled", "blocked")])
    rest_labelled = F.col("all_labelled") - F.col("labelled")
    rest_blocked = F.col("all_blocked") - F.col("blocked")
    pooled = F.col("all_blocked") / F.col("all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest_labelled))
    gap = F.abs(F.col("blocked") / F.col("labelled") - rest_blocked / rest_labelled)
    told, weak = F.col("labelled") > 0, F.col("n") < SUPPORT
    similar = F.when(told & (rest_labelled > 0), gap <= Z * error).otherwise(False)
    merged = told & (similar | weak)
    name = (
        F.when(F.col(level) == "", "").when(merged, MERGED)
        .when(~told & weak, APART).otherwise(F.concat(F.lit("/"), F.col(level))))
    step = branch.join(parent, ["host", "template"]).select("host", "template", level, name.alias("step"))
    return tree.join(pin(step), ["host", "template", level]).withColumn(
        "template", F.concat("template", "step")).drop("step")


def templates(parsed: DataFrame) -> DataFrame:
    """``(host, s1.., template, purity)`` for each different host and path of ``parsed``."""
    tree = parsed.groupBy("host", *LEVELS).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    tree = pin(tree.withColumn("template", F.lit("")))
    used = tree.agg(*[F.max(F.col(level) != "").alias(level) for level in LEVELS]).first()
    for level in LEVELS:
        if used[level]:  # no path is deeper
            tree = pin(_generalised(tree, level))
    own = pin(tree.groupBy("host", "template").agg(*_counts()).select(
        "host", "template", ((F.col("blocked") + SMOOTH / 2) / (F.col("labelled") + SMOOTH)).alias("purity")))
    shown = F.replace(F.replace("template", F.lit(MERGED), F.lit("/*")), F.lit(APART), F.lit("/*"))
    return pin(tree.select("host", *LEVELS, "template").join(own, ["host", "template"]).withColumn("template", shown))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)``, one row per row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path, and no rule. Pages with a rule
    follow it; the others follow their template. Page ids may be null or repeat. Other columns are ignored.
    """
    block = [r.name for r in rules if r.verdict == "block"]
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumns(
        {level: segment(F.col("path"), k, k == DEPTH) for k, level in enumerate(LEVELS, 1)})
    labelled = parsed.withColumn("label", F.when(F.col("rule").isNotNull(), F.col("rule").isin(block).cast("int")))
    known = templates(labelled)
    verdict = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow").when(
        F.col("purity") >= REJECT, "block").otherwise("allow")
    return labelled.join(known, ["host", *LEVELS]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
