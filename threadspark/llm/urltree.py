"""URL filtering: explicit rules first, then a path-template tree per host.

Segments of a path become tree levels. Digits are variable by nature and fold
into ``<n>``; where a node has very many children of one page, those are variable too
and become ``*`` (the label of one page is no share that a test could compare). Of all other
siblings, those whose labelled purity does not differ significantly (two-proportion test)
merge into ``*``, however many children the node has; the rest stay apart. A template is
rejected when its smoothed share of good labelled pages is too low.

All steps are aggregations over (host, shape) counts and equi-joins, so a host
holding a third of the pages is pre-aggregated before any shuffle; the only join of
whole pages is the last one, which adaptive execution splits when a key is hot.
No Python runs on the executors.

Edge cases: a null url or one without ``://`` has empty host and path (and forms
one template); null or repeated labels count as one label per id (good only if all
its rows are good, rows with a null label are ignored); a null page id is kept and is unlabelled;
repeated pages are all returned; very long paths are followed to their end, in rounds that number the branchings;
of rules that fit equally long ones cannot tie, as a host has one rule per path; columns besides id and url are not
read, so none can clash; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import ascii_lower
from threadspark.session import materialize

#: (action, rule); a rule is host + path prefix.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

MANY_CHILDREN = 20
Z2 = 3.8416
SMOOTHING = 10.0
MIN_PURITY = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action (null if none fits)."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def path_shape(path: Column) -> Column:
    """Path segments with digit runs folded, joined by ``/``."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, "[0-9]+", "<n>"), "/"), lambda s: s != ""), "/")


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, lab, good) -> the same with ``template``, down to the last segment of every path.

    The tree is path-compressed: what all paths of a node go on with is taken in one step, so a round is spent on
    every branching along a path, not on every segment. A path that ends in a node is there as the empty segment.
    """
    key = ["host", "template"]
    t = shapes.withColumn("rest", F.filter(F.split("shape", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    ended = []
    while (t.agg(F.max(F.size("rest"))).first()[0] or 0) > 0:
        # the least and the greatest of a node's paths share what all of them share
        ends = t.groupBy(key).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        same = F.array_position(F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        ends = ends.withColumn("shared", F.when(same > 0, same - 1).otherwise(F.size("lo")).cast("int"))
        ends = ends.select(*key, "shared", F.array_join(F.transform(F.slice("lo", F.lit(1), F.col("shared")), lambda s: F.concat(F.lit("/"), s)), "").alias("common"))
        t = t.join(ends, key).withColumns({
            "template": F.concat("template", "common"), "rest": F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest") - F.col("shared"), F.lit(0)))
        }).drop("shared", "common")
        t = materialize(t.withColumn("seg", F.coalesce(F.get("rest", F.lit(0)), F.lit(""))))
        kids = t.groupBy(*key, "seg").agg(F.sum("n").alias("kn"), F.sum("lab").alias("kl"), F.sum("good").alias("kg"))
        few = F.col("kn") < 2
        node = kids.groupBy(key).agg(
            F.count(F.lit(1)).alias("kids"), F.count(F.when(few, 1)).alias("few"), F.sum("kl").alias("nl"), F.sum("kg").alias("ng")
        )
        rate, rest = F.col("kg") / F.nullif(F.col("kl"), F.lit(0)), (F.col("ng") - F.col("kg")) / F.nullif(F.col("nl") - F.col("kl"), F.lit(0))
        pool = F.col("ng") / F.nullif(F.col("nl"), F.lit(0))
        spread = Z2 * pool * (1 - pool) * (1 / F.nullif(F.col("kl"), F.lit(0)) + 1 / F.nullif(F.col("nl") - F.col("kl"), F.lit(0)))
        similar = F.coalesce((rate - rest) * (rate - rest) <= spread, F.lit(True))
        variable = few & (F.col("few") > MANY_CHILDREN)
        name = F.when(F.col("seg") == "", F.lit("")).when((F.col("kids") > 1) & (variable | similar), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("seg")))
        step = kids.join(node, key).select(*key, "seg", F.concat("template", name).alias("next"))
        t = materialize(t.join(step, [*key, "seg"]).drop("template").withColumnRenamed("next", "template"))
        ended.append(t.where("seg = ''").drop("seg"))
        t = t.where("seg <> ''").withColumn("rest", F.slice("rest", F.lit(2), F.size("rest"))).drop("seg")
    out = ["host", "shape", "template", "n", "lab", "good"]
    return reduce(DataFrame.unionByName, [e.select(out) for e in ended], t.select(out))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", rules=RULES) -> DataFrame:
    """One row per page: id, host, path, template, purity, rule, verdict."""
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("shape", path_shape(F.col("path")))
    lab = (
        labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    )
    shapes = materialize(
        base.join(lab, "page_id", "left")
        .groupBy("host", "shape")
        .agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("lab"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    )
    tree = template_tree(shapes)
    prior = shapes.agg((F.sum("good") / F.nullif(F.sum("lab"), F.lit(0))).alias("prior"))
    stats = (
        tree.groupBy("host", "template")
        .agg(F.sum("lab").alias("lab"), F.sum("good").alias("good"))
        .join(F.broadcast(prior))  # one row
        .select("host", "template", ((F.col("good") + SMOOTHING * F.coalesce("prior", F.lit(1.0))) / (F.col("lab") + SMOOTHING)).alias("purity"))
    )
    verdicts = tree.select("host", "shape", "template").join(stats, ["host", "template"])
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < MIN_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return base.join(verdicts, ["host", "shape"]).select(
        "page_id", "host", "path", "template", "purity", rule.alias("rule"), F.coalesce(action, own).alias("verdict")
    )
