"""Robots files as a table of rules, and addresses matched with them by the literal beginnings of the rules.

A rule's path up to its first wildcard is literal. Addresses are cut at the lengths that their site's literals have, so that
site and beginning are the keys of a plain join, however many rules and addresses a site has; wildcards and the end mark are
tested on what meets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = "array<struct<agents: array<string>, delay: double, rules: array<struct<allow: boolean, path: string>>>>"


def read(text: str | None) -> list[dict]:
    """Groups of a robots file in order: agents in lower case, crawl delay, rules. An agent line after a rule, or after an
    empty line that ends a group with rules, begins a group; comments and unknown lines are left out."""
    groups: list[dict] = []
    open_, ruled = None, False
    for line in (text or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if open_ is None or ruled:
                open_, ruled = {"agents": [], "delay": None, "rules": []}, False
                groups.append(open_)
            open_["agents"].append(value.lower())
        elif open_ is not None and name in ("allow", "disallow"):
            ruled = True
            if value:  # an empty Disallow forbids nothing
                open_["rules"].append({"allow": name == "allow", "path": value})
        elif open_ is not None and name == "crawl-delay":
            ruled = True
            if re.fullmatch(r"\d+(\.\d+)?", value):
                open_["delay"] = float(value)
    return groups


def decoded(path: Column) -> Column:
    """Percent signs resolved, plus signs kept; as it is where that fails."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def group_for(groups: Column, agent: str) -> Column:
    """The first group that names the agent (a part of its name before the slash), else the first for all, else null."""
    token = agent.split("/")[0].lower()
    named = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: (a != "*") & (a != "") & F.contains(F.lit(token), a)))
    every = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    return F.coalesce(F.get(named, F.lit(0)), F.get(every, F.lit(0)))


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """(site, delay, place, allow, path, literal, pattern) of each rule for an agent from robots files (site, text); a site
    whose group has no rules gives one row without a path. Of several files of a site the first by text counts."""
    one = robots.where("site is not null").groupBy("site").agg(F.min("text").alias("text"))
    chosen = one.select("site", group_for(F.udf(read, GROUPS, useArrow=True)("text"), agent).alias("g")).where("g is not null")
    rows = chosen.select("site", F.col("g.delay").alias("delay"), F.posexplode_outer("g.rules").alias("place", "r"))
    path = decoded(F.col("r.path"))
    ends = path.endswith("$")
    bare = F.when(ends, F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    # letters, digits and slashes as they are, * as anything, all else quoted
    pattern = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(bare, r"([^\p{L}\p{N}/*])", r"\\$1"), r"\*+", ".*"), F.when(ends, "$").otherwise(""))
    return rows.select("site", "delay", "place", F.col("r.allow").alias("allow"), path.alias("path"), F.when(path.isNotNull(), F.split_part(bare, F.lit("*"), F.lit(1))).alias("literal"), pattern.alias("pattern"))


def judged(addresses: DataFrame, site: str, target: str, known: DataFrame, first: bool = False) -> DataFrame:
    """addresses with `allowed` and `delay`: target is the address's path and query. Of the rules that match, the longest path
    decides, and of equals one that allows; with `first` the one that stands first, as in the standard library. No rule, no
    robots file or no site: allowed."""
    at = F.when(F.coalesce(F.col(target), F.lit("")) == "", F.lit("/")).otherwise(decoded(F.col(target)))
    lengths = known.groupBy(F.col("site").alias("__site")).agg(F.first("delay").alias("delay"), F.array_distinct(F.collect_set(F.length("literal"))).alias("__lengths"))
    keyed = addresses.withColumns({"__at": at, "__id": F.monotonically_increasing_id()})
    # one row for each address and what could decide it; an address that no rule meets comes back by the outer join
    sited = keyed.join(lengths, F.col(site) == F.col("__site"), "left").drop("__site")
    cut = sited.withColumn("__n", F.explode_outer(F.filter("__lengths", lambda n: n <= F.length("__at")))).withColumn("__cut", F.substring("__at", F.lit(1), F.col("__n"))).drop("__lengths", "__n")
    held = known.where("path is not null").select(F.col("site").alias("__site"), "literal", "pattern", "allow", "path", "place")
    met = cut.join(held, (F.col(site) == F.col("__site")) & (F.col("__cut") == F.col("literal")), "left")
    fits = F.coalesce(F.rlike("__at", F.col("pattern")), F.lit(False))
    rank = F.when(fits, F.struct((-F.col("place")).alias("a"), F.col("allow").alias("allow")) if first else F.struct(F.length("path").alias("a"), F.col("allow").alias("allow")))
    names = [c for c in addresses.columns]
    best = met.groupBy("__id").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in names], F.first("delay").alias("delay"), F.max(rank).alias("__best"))
    return best.select(*[F.col(f"`{c}`") for c in names], F.coalesce("__best.allow", F.lit(True)).alias("allowed"), "delay")
