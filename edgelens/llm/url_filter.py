"""URL verdicts: listed rules first, then a path-template tree.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path:
what follows up to ``?``, ``#`` or the end. Both are empty for null and where ``://`` is
missing. A rule fits its host and all subdomains if the path starts with the rule's;
the longest that fits decides.

For the other pages the tree decides. Pages that a rule fits are its labelled pages.
Level by level, the segments below one node of a tree are merged into a wildcard where
the labels do not tell them from their siblings (two proportions, ``Z`` standard errors
apart, the siblings smoothed as below) or where fewer than ``LEAST`` of their pages are
labelled. A segment without labelled pages is not told apart, so segments that vary are a
wildcard. The segments that are told apart are merged with each other where they are
alike: those of one twentieth of purity, and neighbouring twentieths whose labels do not
differ by ``Z`` standard errors. A merged branch is called by its first segment and a
tilde.

There is a tree per host, one per suffix (the last label of a host) and one of all hosts.
A page's purity is the share of allowed pages among the labelled ones of its template,
smoothed by ``PRIOR`` pages: in the tree of all hosts of the purity of all labelled pages,
in a suffix's tree of the page's purity in the tree of all, in a host's tree of that in
its suffix's. So a host without labels is judged by what its paths mean elsewhere, and
own labels overrule that as they grow. A page is blocked if its purity is below ``PURE``.
``template`` is that of the narrowest tree with labelled pages of it, ``scope`` its kind.

Beyond ``DEPTH`` levels only the nodes that labels can still divide go on, those with
labelled pages that are mixed with others (a level where no such node branches is
passed over); the segments that are left are one wildcard tail. Nothing that labels tell
apart is lost by it, only the number of wildcards in a template.

Everything works on distinct (host, path) pairs with counts, so a busy host or page is
combined before it is shuffled. Empty table: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from edgelens.llm.common import ascii_lower
from edgelens.session import written

# Fixed values: (host, path prefix, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
Z = 1.96
PRIOR = 10.0
PURE = 0.5
LEAST = 5
DEPTH = 8
ALIKE = "~"
WILDCARD = "*"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, prefix, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def purity(labelled: Column, good: Column, base: float) -> Column:
    """Allowed share of labelled pages, smoothed by ``PRIOR`` pages of purity ``base``."""
    return (good + PRIOR * base) / (labelled + PRIOR)


def _told_apart(good: Column, labelled: Column, all_good: Column, all_labelled: Column, base: float) -> Column:
    """Whether a branch's allowed share differs from the smoothed one of its siblings."""
    others = all_labelled - labelled + PRIOR
    others_good = all_good - good + PRIOR * base
    pooled = (good + others_good) / (labelled + others)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), labelled) + 1 / others))
    apart = F.abs(F.try_divide(good, labelled) - others_good / others) > Z * spread
    return F.coalesce(apart, F.lit(False))


def _merged(kept: DataFrame, base: float) -> DataFrame:
    """host, template, segment of branches, and the ``literal`` that alike ones share.

    A node has at most 21 twentieths, however many branches it has.
    """
    node = ["host", "template"]
    kept = kept.withColumn("twentieth", F.round(20 * purity(F.col("labelled"), F.col("good"), base)).cast("int"))
    parts = kept.groupBy(*node, "twentieth").agg(*(F.sum(c).alias(c) for c in ("labelled", "good")))
    order = Window.partitionBy(*node).orderBy("twentieth")
    good, labelled = F.col("good"), F.col("labelled")
    before_good, before = F.lag("good").over(order), F.lag("labelled").over(order)
    pooled = (good + before_good) / (labelled + before)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / before))
    differs = F.abs(good / labelled - before_good / before) > Z * spread
    parts = parts.withColumn("differs", F.coalesce(differs, F.lit(True)).cast("int"))
    parts = parts.select(*node, "twentieth", F.sum("differs").over(order).alias("branch"))
    placed = kept.join(parts, [*node, "twentieth"])
    names = placed.groupBy(*node, "branch").agg(F.min("segment").alias("first"), F.count(F.lit(1)).alias("members"))
    name = F.concat("first", F.when(F.col("members") > 1, ALIKE).otherwise(""))
    return placed.join(names, [*node, "branch"]).select(*node, "segment", name.alias("literal"))


def _divided(state: DataFrame, level: int, columns: list[str], base: float) -> DataFrame:
    """``state`` with the segments of ``level`` added to the templates."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    state = state.withColumn("segment", F.get("segments", F.lit(level)))
    branches = state.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(*sums)
    branches = written(branches, "branches")
    nodes = branches.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "good")))
    counts = [F.col(c) for c in ("good", "labelled", "all_good", "all_labelled")]
    apart = _told_apart(*counts, base) & (F.col("labelled") >= LEAST)
    kept = written(branches.join(nodes, ["host", "template"]).where(apart), "apart")
    kept = _merged(kept, base)
    step = F.when(F.col("literal").isNotNull(), F.col("literal")).when(F.col("segment").isNotNull(), F.lit(WILDCARD))
    state = state.join(kept, ["host", "template", "segment"], "left").select(
        *columns, "segments", F.concat_ws("/", F.col("template"), step).alias("template")
    )
    return written(state, "level")


def _open_nodes(state: DataFrame, level: int) -> DataFrame:
    """Nodes that labels can divide below ``level``, and how many segments all their pages share."""
    rest = F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0)))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    ends = [F.min(rest).alias("least"), F.max(rest).alias("most")]
    nodes = state.where(F.size("segments") > level).groupBy("host", "template").agg(*sums, *ends)
    mixed = (F.col("good") > 0) & (F.col("good") < F.col("labelled")) | (F.col("labelled") < F.col("n"))
    same = F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b))
    nodes = nodes.where((F.col("labelled") > 0) & mixed & (F.col("least") != F.col("most")))
    return nodes.select("host", "template", (F.array_position(same, False) - 1).cast("int").alias("shared"))


def templates(paths: DataFrame, base: float) -> DataFrame:
    """``paths`` (host, path, n, labelled, good) with the ``template`` of each path."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    state = paths.withColumn("segments", segments).withColumn("template", F.lit(""))
    depth = state.agg(F.max(F.size("segments"))).first()[0] or 0
    done, level = [], 0

    def closed(rows: DataFrame, level: int) -> DataFrame:
        tail = F.when(F.size("segments") > level, F.lit("/**")).otherwise("")
        return rows.select(*paths.columns, F.concat("template", tail).alias("template"))

    while level < depth:
        if level >= DEPTH:
            nodes = written(_open_nodes(state, level), "open")
            shared = nodes.agg(F.min("shared")).first()[0]
            if shared is None:
                break
            reached = state.join(nodes, ["host", "template"], "left")
            # Pages that end here are no part of the node's branches.
            on = F.col("shared").isNotNull() & (F.size("segments") > level)
            done.append(closed(reached.where(~on), level))
            common = F.concat_ws("/", "template", F.slice("segments", level + 1, shared))
            state = reached.where(on).select(*paths.columns, "segments", common.alias("template"))
            level += shared
        state = _divided(state, level, paths.columns, base)
        level += 1
    return reduce(DataFrame.unionByName, [*done, closed(state, level)])


def judged(paths: DataFrame) -> DataFrame:
    """host, path, and the template, scope and purity by which a page is judged."""
    paths = written(paths, "paths")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("labelled", "good")]
    base = float(paths.agg(*sums).select(purity(F.col("labelled"), F.col("good"), 1.0)).first()[0])
    scopes = {"all": F.lit(""), "suffix": F.substring_index("host", ".", -1), "host": F.col("host")}
    pages = paths.select("host", "path", F.lit(base).alias("purity"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("template"))
    for scope, key in scopes.items():
        grouped = paths.groupBy(key.alias("host"), "path").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "good")))
        known = written(templates(written(grouped, "grouped"), base), "templates")
        leaves = known.groupBy("host", "template").agg(*sums)
        found = known.select("host", "path", "template").join(leaves, ["host", "template"])
        found = found.select(F.col("host").alias("key"), "path", F.col("template").alias("own"), "labelled", "good")
        here = (F.col("labelled") > 0) | F.col("scope").isNull()
        pages = pages.withColumn("key", key).join(found, ["key", "path"]).select(
            "host",
            "path",
            ((F.col("good") + PRIOR * F.col("purity")) / (F.col("labelled") + PRIOR)).alias("purity"),
            F.when(here, F.lit(scope)).otherwise(F.col("scope")).alias("scope"),
            F.when(here, F.col("own")).otherwise(F.col("template")).alias("template"),
        )
        pages = written(pages, "judged")
    return pages


def verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, scope and purity of every page."""
    parsed = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    rule, decision = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    parsed = written(parsed.withColumn("rule", rule).withColumn("listed", decision), "pages")
    paths = parsed.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("listed").alias("labelled"),
        F.count_if(F.col("listed") == "allow").alias("good"),
    )
    found = judged(paths)
    by_tree = F.when(F.col("purity") >= PURE, F.lit("allow")).otherwise(F.lit("block"))
    return parsed.join(found, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("listed", by_tree).alias("verdict"), "template", "scope", "purity"
    )
