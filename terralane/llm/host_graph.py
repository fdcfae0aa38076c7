"""URL filters: fixed rules, then trust and distrust spread over links between hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path); a rule is written host + path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Half of a host's score is that of its own pages, half comes along its links.
DAMPING = 0.5
#: Share of all mass that may be outstanding when the walks end.
RESIDUAL = 1e-7
#: A host goes where blocked pages are so much more of what reaches it than trusted ones.
THRESHOLD = 0.15


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lowered; else empty."""
    return F.coalesce(_ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, counted before any join.

    These are the absolute links of the pages, and one from and to the domain above for
    every page of a host (m.site.example.org, site.example.org, example.org), as the hosts
    of a site and of a domain link each other in menus. A domain needs no pages of its own.
    """
    own = host_of(F.col("url"))
    links = F.regexp_extract_all(
        F.coalesce(F.col("html"), F.lit("")),
        F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""),
        F.lit(1),
    )
    target = F.transform(
        links, lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("http:"), u)).otherwise(u))
    )
    linked = (
        pages.select(own.alias("src"), F.explode(target).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    hosts = pages.select(own.alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    parts = F.split("host", r"\.")
    name = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 2),
        lambda i: F.array(
            F.struct(name(i).alias("src"), name(i + 1).alias("dst")),
            F.struct(name(i + 1).alias("src"), name(i).alias("dst")),
        ),
    )
    above = hosts.where(F.size(parts) > 2).select("n", F.explode(F.flatten(steps)).alias("e"))
    return (
        linked.unionByName(above.select("e.src", "e.dst", "n"))
        .where("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.sum("n").alias("n"))
    )


def spread(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL
) -> DataFrame:
    """host, trust, distrust: shares of trusted and blocked pages in what reaches a host.

    ``seeds`` has host, pages, trusted, blocked: counts. Trust is personalised PageRank
    from trusted pages over that from all pages, along links; distrust the same from blocked
    pages, against them. Restarts of all pages sum to one. The walks run as one frame of
    what is still moving, so a round is one join and one sum; they end when what could
    still arrive is at most ``residual``.
    """
    ahead = edges.select("src", "dst", "n", F.explode(F.array(F.lit("trust"), F.lit("pages"))).alias("way"))
    back = edges.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.explode(F.array(F.lit("distrust"), F.lit("back"))).alias("way")
    )
    ways = ahead.unionByName(back)
    out = ways.groupBy("src", "way").agg(F.sum("n").alias("all"))
    shares = materialize(
        ways.join(out, ["src", "way"]).select(
            "src", "dst", "way", (F.col("n") / F.col("all")).alias("share")
        ),
        "host-shares",
    )
    total = seeds.agg(F.sum("pages").alias("n")).first().n or 1
    start = seeds.select(
        "host",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(way).alias("way"), ((1 - damping) * F.col(c) / total).alias("score"))
                    for way, c in (("trust", "trusted"), ("pages", "pages"), ("distrust", "blocked"), ("back", "pages"))
                )
            )
        ).alias("s"),
    ).select("host", "s.way", "s.score")
    moving = materialize(start.where("score > 0"), "host-moving")
    arrived, outstanding = [moving], 1.0
    while outstanding > residual:
        steps = []
        # A few rounds a job; what is still moving shrinks by the damping at least.
        for _ in range(4):
            moving = (
                shares.join(moving.withColumnRenamed("host", "src"), ["src", "way"])
                .groupBy(F.col("dst").alias("host"), "way")
                .agg((damping * F.sum(F.col("share") * F.col("score"))).alias("score"))
            )
            moving = moving.withColumn("step", F.lit(len(steps)))
            steps.append(moving)
            moving = moving.drop("step")
        written = materialize(reduce(DataFrame.unionByName, steps), "host-moving")
        arrived.append(written.drop("step"))
        moving = written.where(F.col("step") == 3).drop("step")
        mass = moving.groupBy("way").agg(F.sum("score").alias("m")).agg(F.max("m").alias("m")).first().m or 0.0
        outstanding = mass * damping / (1 - damping)
    score = lambda way: F.sum(F.when(F.col("way") == way, F.col("score")).otherwise(0.0))
    part = lambda a, b: F.coalesce(score(a) / F.nullif(score(b), F.lit(0.0)), F.lit(0.0))
    return (
        reduce(DataFrame.unionByName, arrived)
        .groupBy("host")
        .agg(part("trust", "pages").alias("trust"), part("distrust", "back").alias("distrust"))
    )


def judge(
    pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, **walk
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``.

    A rule decides where one fits. Elsewhere the host is blocked if its distrust exceeds
    its trust by ``threshold`` or more (both from 0 to 1), else allowed; a host that no seed
    reaches is allowed, and so is an empty one. A null url or one without ``://`` has an empty host
    and path. Repeated rows count and come back as often as they occur; other columns
    are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = named.withColumns({"rule": rule, "ruled": verdict})
    seeds = materialize(
        ruled.where("host != ''")
        .groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("ruled") == "allow").alias("trusted"),
            F.count_if(F.col("ruled") == "block").alias("blocked"),
        ),
        "host-seeds",
    )
    scores = spread(seeds, host_edges(pages), **walk)
    return ruled.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(
            "ruled",
            F.when(
                F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) >= threshold,
                "block",
            ).otherwise("allow"),
        ).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
