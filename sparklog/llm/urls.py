"""URL filters: explicit rules, and for the rest a tree of path templates.

The pages that a rule decides are the labels. Per host, paths form a tree of
segments. Level by level, segments that vary by their form (numbers, hex, mixed
names) become wildcards, and a branch stays apart from its siblings only if its
share of blocked labels differs from theirs beyond chance, however many pages or
siblings it has; all other branches merge into the wildcard. Branches that stay
apart merge with each other where their shares fall into one class, so that what
lies below them is judged together. A template is rejected by its smoothed purity:
the blocked share of its labels, drawn towards its host's share, which is drawn
towards that of all pages.

Everything here is DataFrame expressions. The tree is built on the distinct
shapes of paths with their counts, not on pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Levels of the tree for degenerate paths; their deeper segments share the class ``{deep}``.
DEEPEST = 64
#: Only in the SQL, which has a fixed number of levels; no given path is deeper.
DEPTH = 6
#: Standard errors from which a branch's blocked share counts as its own, and how many
#: branches may be compared at that; for more, the bound rises so that no more differ by chance.
APART, FANOUT = 1.96, 32
#: Classes of blocked shares in which branches merge with each other.
RATES = 4
#: Labels that a prior weighs, and the purity above which a template is blocked.
SMOOTHING, PURITY = 4.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/?#``, A-Z lower-cased; path from there up to ``?#``; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, host + path) and its verdict; null if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Among rules of equal length the first in code point order wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments, those that vary by their form written as a class."""
    kind = lambda s: (
        F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.([A-Za-z0-9]+)$", 1)))
        .when(s.rlike(r"^[0-9A-Fa-f-]{16,}$"), F.lit("{h}"))
        .when(s.rlike(r"[0-9]"), F.lit("{v}"))
        .when(F.length(s) > 64, F.lit("{l}"))
        .otherwise(s)
    )
    parts = F.transform(F.split(F.substr(path, F.lit(2)), "/", -1), kind)
    return F.when(F.size(parts) <= DEEPEST, parts).otherwise(F.concat(F.slice(parts, 1, DEEPEST - 1), F.array(F.lit("{deep}"))))


def templates(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds the template of each row of ``shapes`` (host, shape, n, labelled, blocked)."""
    rows = shapes.withColumn("template", F.array().cast("array<string>"))
    deepest = rows.agg(F.max(F.size("shape"))).collect()[0][0] or 0
    for level in range(1, deepest + 1):
        here = rows.where(F.size("shape") >= level)
        sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
        children = here.withColumn("segment", F.get("shape", F.lit(level - 1))).groupBy("host", "template", "segment").agg(*sums)
        literal = ~F.col("segment").startswith("{")
        parents = children.groupBy("host", "template").agg(F.sum((literal & (F.col("labelled") > 0)).cast("long")).alias("compared"), *[F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")])
        # The branch against its siblings: a two-sample test of blocked shares.
        others, bad = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
        pooled = F.try_divide(F.col("all_blocked"), F.col("all_labelled"))
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), others)))
        # The tail of the normal distribution falls with exp(-bound ** 2 / 2).
        bound = F.sqrt(F.lit(APART**2) + 2 * F.log(F.greatest(F.col("compared") / F.lit(float(FANOUT)), F.lit(1.0))))
        differs = F.when((F.col("labelled") > 0) & (others > 0) & (pooled > 0) & (pooled < 1), F.abs(F.try_divide(F.col("blocked"), F.col("labelled")) - F.try_divide(bad, others)) > bound * error).otherwise(F.lit(False))
        rate = F.floor(F.try_divide("blocked", "labelled") * RATES + 0.5).cast("int")
        tested = scratch.save(children.join(parents, ["host", "template"]).select("host", "template", "segment", F.when(differs & literal, rate).alias("rate")), f"tested{level}")
        peers = tested.where("rate is not null").groupBy("host", "template", "rate").agg(F.count("*").alias("peers"))
        name = F.when(F.col("rate").isNull(), F.lit("*")).when(F.col("peers") > 1, F.concat(F.lit("{share "), F.col("rate").cast("string"), F.lit("}"))).otherwise(F.col("segment"))
        joined = tested.join(peers, ["host", "template", "rate"], "left").select(F.col("host").alias("c_host"), F.col("template").alias("c_template"), F.col("segment").alias("c_segment"), name.alias("name"))
        match = (F.col("host") == F.col("c_host")) & (F.col("template") == F.col("c_template")) & (F.get("shape", F.lit(level - 1)) == F.col("c_segment"))
        rows = rows.join(joined, match, "left").withColumn("template", F.when(F.col("name").isNotNull(), F.concat("template", F.array("name"))).otherwise(F.col("template"))).drop("c_host", "c_template", "c_segment", "name")
        rows = scratch.save(rows, f"level{level}")
    return rows


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], scratch: Scratch | None = None) -> DataFrame:
    """Judges each row of ``pages`` (page_id, url).

    Returns page_id, host, path, rule (the text of the rule that fits, or null),
    template, purity and verdict: the rule's, else ``block`` where the
    template's purity is above ``PURITY``, else ``allow``.

    A null url, or one without ``://``, has an empty host and path and the
    template of that shape. Very long segments share a class. Repeated rows and
    page_ids are judged each by itself and count each. Other columns are
    ignored. An empty table gives no rows; without any label the shares are 0.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("said", said).withColumn("shape", shape(F.col("path")))
    count = lambda c: F.sum(c.cast("long"))
    shapes = scratch.save(parsed.groupBy("host", "shape").agg(F.count("*").alias("n"), count(F.col("said").isNotNull()).alias("labelled"), count(F.coalesce(F.col("said") == "block", F.lit(False))).alias("blocked")), "shapes")
    named = templates(shapes, scratch)
    everywhere = named.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("rate")).collect()[0][0]
    draw = lambda prior: (F.sum("blocked") + F.lit(SMOOTHING) * prior) / (F.sum("labelled") + F.lit(SMOOTHING))
    hosts = named.groupBy("host").agg(draw(F.lit(float(everywhere))).alias("host_rate"))
    pure = named.join(hosts, "host").groupBy("host", "template").agg(draw(F.first("host_rate")).alias("purity"))
    verdicts = scratch.save(named.join(pure, ["host", "template"]).select(F.col("host").alias("v_host"), F.col("shape").alias("v_shape"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"), "verdicts")
    found = parsed.join(verdicts, (F.col("host") == F.col("v_host")) & (F.col("shape") == F.col("v_shape")))
    verdict = F.coalesce("said", F.when(F.col("purity") > PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
