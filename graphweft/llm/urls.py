"""URL filters: explicit rules first, then a tree of path templates for each host.

Paths are cut in segments. Segments that look generated (numbers, hexadecimal digests, long mixed names) become
wildcards at once, and a segment that repeats itself counts once; level by level, a node's rare segments become one
wildcard where it has many children. Pages are labelled by the rules (or a table of labels). Labelled branches of one
node whose blocked share isn't significantly different from the node's are merged. A branch without labelled pages joins
them if it is like the labelled ones by two-sample tests: of its number of pages against theirs, and of the share of
pages that go on with a generated segment. If it isn't, it has what its parent has, weighed by how much of the two
it shares with them. Shares are smoothed towards the level above, from the top-level domain through subdomains to the
host, and from there along the path; above the top-level domain stands 0, and where a node has no labelled branch its
branches have what it has. A template is rejected when its smoothed blocked share is above one half.

Levels go on until each page's template is told from all others of its host: what is left of a path that no other page
shares isn't split further, so there are as many rounds as the tree has levels that branch, whatever the paths' length.
DataFrame functions only.

Defined results: a null url, or one without ://, has empty host and path, no rule and the verdict allow; so has any
page of a top-level domain without labels. Rows are answered one by one; repeated page_ids count as several pages. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import materialise

#: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Below a node with more children, those with fewer pages than RARE become wildcards.
CHILDREN, RARE = 20, 5
#: Pseudo-pages with the share of the level above.
SMOOTHING = 2.0
#: Above this many standard deviations two shares differ.
DEVIATIONS = 1.96
THRESHOLD = 0.5

HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
#: Numbers, with an extension or not; hexadecimal digests; long names that mix letters and digits.
GENERATED = r"^([0-9]+([.][a-z]+)?|[0-9a-fA-F-]{16,}|(?=.*[0-9])(?=.*[A-Za-z]).{20,})$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments, generated ones as *, without repeats of the one before."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    marked = F.transform(parts, lambda s: F.when(s.rlike(GENERATED), F.lit("*")).otherwise(s))
    # a segment joined with the one before it tells whether it repeats that
    before = F.concat(F.array(F.lit("")), marked)
    both = F.filter(F.arrays_zip(marked.alias("own"), F.slice(before, F.lit(1), F.size(marked)).alias("before")), lambda x: x["own"] != x["before"])
    return F.transform(both, lambda x: x["own"])


def smoothed(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + SMOOTHING * above) / (labelled + SMOOTHING)


def host_shares(nodes: DataFrame) -> DataFrame:
    """host, purity from rows (host, labelled, blocked): smoothed from the top-level domain down to the host. A level
    with the same labelled pages as the one above tells nothing new."""
    hosts = nodes.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    names = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), -i, i), '.'))")
    levels = hosts.select("host", "labelled", "blocked", F.posexplode(names).alias("level", "domain"))
    domains = levels.groupBy("domain").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("k"))
    chain = F.array_sort(F.collect_list(F.struct("level", "n", "k")))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(-1).cast("long").alias("n"))
    down = F.aggregate(chain, start, lambda up, x: F.when(x["n"] == up["n"], up).otherwise(F.struct(smoothed(x["k"], x["n"], up["p"]).alias("p"), x["n"].alias("n"))))
    return levels.select("host", "level", "domain").join(domains, "domain").groupBy("host").agg(down["p"].alias("purity"))


def _compared() -> tuple[Column, Column, Column, Column]:
    """Pages of a branch and of the mean labelled one beside it, and their shares of pages with a generated segment next."""
    return F.col("own_pages"), F.try_divide(F.col("known_pages"), F.col("known")), F.col("own_starred") / F.col("own_pages"), F.try_divide(F.col("known_starred"), F.col("known_pages"))


def like() -> Column:
    """Do neither the number of pages nor the share of generated segments differ significantly from the labelled branches'?"""
    pages, mean, share, other = _compared()
    both = (F.col("own_starred") + F.col("known_starred")) / (F.col("own_pages") + F.col("known_pages"))
    counts = F.abs(pages - mean) <= DEVIATIONS * F.sqrt(pages + mean)
    return counts & (F.abs(share - other) <= DEVIATIONS * F.sqrt(both * (1 - both) * (1 / pages + F.try_divide(F.lit(1), F.col("known_pages")))))


def likeness() -> Column:
    """1 for a branch with as many pages and as large a share as the labelled ones, falling to 0."""
    pages, mean, share, other = _compared()
    return 2 * F.least(pages, mean) / (pages + mean) * (1 - F.abs(share - other))


def templates(pages: DataFrame) -> DataFrame:
    """host, shape, template, purity from rows (host, shape, blocked: 1, 0 or null).

    shape (segments with what looks generated replaced) is the key; equal ones are one row from here on, so a host with
    a third of all pages has as many rows as it has shapes. All sums are taken before the shuffle.
    """
    nodes = pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))
    nodes = materialise(nodes)
    columns = ["host", "shape", "template", "purity"]
    live = materialise(nodes.join(host_shares(nodes), "host").withColumn("template", F.lit("")).withColumn("rest", F.col("shape")))
    ended = None
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    node = ["host", "template"]
    while True:
        live = live.withColumn("segment", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        tail = F.slice("rest", F.lit(2), F.greatest(F.size("rest"), F.lit(1)))
        children = live.groupBy(*node, "segment").agg(F.sum("pages").alias("pages"), F.sum(F.when(F.get("rest", F.lit(1)) == "*", F.col("pages")).otherwise(0)).alias("starred"), F.count(F.lit(1)).alias("shapes"), F.min(tail).alias("low"), F.max(tail).alias("high"), *sums)
        parents = children.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("shapes").alias("all_shapes"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        wild = (F.col("children") > CHILDREN) & (F.col("pages") < RARE)
        step = F.when(F.col("segment") == "", F.lit("")).when(wild, F.lit("/*")).otherwise(F.concat(F.lit("/"), "segment"))
        steps = children.join(parents, node).withColumn("step", step)
        # what the least and the greatest tail of a branch begin with, all between them begin with, too: no need for a round
        common = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        branches = steps.groupBy(*node, "step").agg(*sums, F.sum("pages").alias("own_pages"), F.sum("starred").alias("own_starred"), F.first("all_labelled").alias("n"), F.first("all_blocked").alias("k"), F.sum("shapes").alias("own_shapes"), F.min("low").alias("low"), F.max("high").alias("high"))
        branches = branches.withColumn("same", F.when(common == 0, F.size("low")).otherwise(common - 1).cast("int")).drop("low", "high")
        share = F.try_divide(F.col("k"), F.col("n"))
        apart = F.abs(F.col("blocked") - F.col("labelled") * share) > DEVIATIONS * F.sqrt(F.col("labelled") * share * (1 - share))
        branches = branches.withColumn("apart", F.coalesce(apart, F.lit(False))).withColumnsRenamed({"labelled": "own_labelled", "blocked": "own_blocked"})
        alike = lambda c: F.sum(F.when(~F.col("apart"), F.col(c)))
        known = lambda c: F.coalesce(F.sum(F.when(F.col("own_labelled") > 0, c)), F.lit(0))
        merged = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("branches"), alike("own_labelled").alias("merged_labelled"), alike("own_blocked").alias("merged_blocked"), known(F.lit(1)).alias("known"), known(F.col("own_pages")).alias("known_pages"), known(F.col("own_starred")).alias("known_starred"))
        told = steps.select(*node, "segment", "step", "all_shapes").join(branches.select(*node, "step", "apart", "same", "own_shapes", "own_labelled", "own_blocked", "own_pages", "own_starred"), [*node, "step"]).join(merged, node)
        alone, pick = F.col("all_shapes") == 1, lambda c: F.when(F.col("apart"), F.col(f"own_{c}")).otherwise(F.col(f"merged_{c}"))
        strange = (F.col("own_labelled") == 0) & (F.col("known") > 0) & ~like()
        purity = F.when(alone | (F.col("branches") == 1), F.col("purity")).when(strange, F.col("purity") * likeness()).otherwise(smoothed(pick("blocked"), pick("labelled"), F.col("purity")))
        joined = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("/"), F.array_join(c, "/"))).otherwise(F.lit(""))
        added = F.when(alone, joined(F.col("rest"))).otherwise(F.concat("step", joined(F.slice(tail, F.lit(1), F.col("same")))))
        after = live.join(told, [*node, "segment"]).select("host", "shape", "pages", "labelled", "blocked", purity.alias("purity"), F.concat("template", added).alias("template"), F.slice(tail, F.col("same") + 1, F.greatest(F.size("rest"), F.lit(1))).alias("rest"), (alone | (F.col("segment") == "") | (F.col("own_shapes") == 1)).alias("ended"))
        after = materialise(after)
        done = after.filter("ended").select(*columns)
        ended = done if ended is None else ended.union(done)
        live = after.filter("NOT ended").drop("ended")
        if not live.limit(1).count():
            return ended


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. labels: (page_id, blocked), instead of the rules' verdicts."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("shape", segments(F.col("path")))
    if labels is None:
        known = rows.withColumn("blocked", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    else:
        known = rows.join(labels.groupBy("page_id").agg(F.max("blocked").cast("int").alias("blocked")), "page_id", "left")
    judged = templates(known.select("host", "shape", "blocked"))
    # the left side holds hot hosts' pages; both sides are shuffled by the join, which AQE splits where one is skewed
    out = rows.join(judged, ["host", "shape"], "left")
    method = F.when(F.col("purity") > THRESHOLD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
