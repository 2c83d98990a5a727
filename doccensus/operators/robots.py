"""Crawler access from robots.txt bodies.

A file is one row and is folded inside that row, so no line is shuffled and a
site with a huge file costs one task no more than reading it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import html as H
from doccensus.functions.common import c, extract, trim_ws

# Crawlers of the older check, agent and owner
BOTS_V1 = [
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "PerplexityBot", "Amazonbot",
    "Bingbot", "Bytespider", "Google-Extended",
]

_BLOCK = "struct<agents:array<string>,has_allow:boolean,disallow_all:boolean>"
_STATE = f"struct<done:array<{_BLOCK}>,agents:array<string>,has_allow:boolean,disallow_all:boolean,collecting:boolean>"


def _lines(body: Column) -> Column:
    return F.transform(F.split(body, "\n"), lambda x: trim_ws(x))


def _value(line: Column, field: str) -> Column:
    """Trimmed value of a ``Field: value`` line, null for other lines."""
    return F.when(F.lower(line).startswith(field + ":"), trim_ws(F.substr(line, F.lit(len(field) + 2))))


def _flush(s: Column) -> Column:
    closed = F.array(
        F.struct(s["agents"].alias("agents"), s["has_allow"].alias("has_allow"), s["disallow_all"].alias("disallow_all"))
    )
    return F.when(F.size(s["agents"]) > 0, F.concat(s["done"], closed)).otherwise(s["done"])


def blocks(body: Column | str) -> Column:
    """Rule groups in file order: array of (agents, has_allow, disallow_all)."""

    def step(s, line):
        agent, allow, deny = _value(line, "user-agent"), _value(line, "allow"), _value(line, "disallow")
        blank = (line == "") | line.startswith("#")
        joins = s["collecting"] & (F.size(s["agents"]) > 0)
        fresh = agent.isNotNull() & ~joins
        return F.struct(
            F.when(fresh, _flush(s)).otherwise(s["done"]).alias("done"),
            F.when(fresh, F.array(agent)).when(agent.isNotNull(), F.concat(s["agents"], F.array(agent))).otherwise(s["agents"]).alias("agents"),
            F.when(fresh, False).otherwise(
                s["has_allow"] | ((F.size(s["agents"]) > 0) & (F.coalesce(allow != "", F.lit(False)) | F.coalesce(deny == "", F.lit(False))))
            ).alias("has_allow"),
            F.when(fresh, False).otherwise(
                s["disallow_all"] | ((F.size(s["agents"]) > 0) & F.coalesce(deny == "/", F.lit(False)))
            ).alias("disallow_all"),
            F.when(agent.isNotNull(), True).otherwise(F.lit(False)).alias("collecting"),
        ).cast(_STATE)

    start = F.struct(
        F.array().cast(f"array<{_BLOCK}>").alias("done"), F.array().cast("array<string>").alias("agents"),
        F.lit(False).alias("has_allow"), F.lit(False).alias("disallow_all"), F.lit(False).alias("collecting"),
    ).cast(_STATE)
    return F.aggregate(_lines(c(body)), start, step, _flush)


def robots_blocks(site_files: DataFrame) -> DataFrame:
    """One row per (domain, block) with sorted agents and the two rule flags."""
    exploded = site_files.select("domain", F.posexplode(blocks("body")).alias("block", "b"))
    return exploded.select(
        "domain", F.col("block").cast("long").alias("block"), F.array_sort(F.array_distinct("b.agents")).alias("agents"),
        F.col("b.has_allow").alias("has_allow"), F.col("b.disallow_all").alias("disallow_all"),
    )


def agent_status(rule_blocks: Column, agent: Column, case_insensitive: bool = False) -> Column:
    """allowed / blocked / not-mentioned for one agent against parsed blocks."""
    fold = F.lower if case_insensitive else (lambda x: x)
    names = lambda b: F.transform(b["agents"], fold) if case_insensitive else b["agents"]
    verdict = lambda b: F.when(b["disallow_all"] & ~b["has_allow"], "blocked").otherwise("allowed")
    own = F.get(F.filter(rule_blocks, lambda b: F.array_contains(names(b), fold(agent))), F.lit(0))
    star = F.get(
        F.filter(rule_blocks, lambda b: F.array_contains(b["agents"], "*") & (b["disallow_all"] | b["has_allow"])), F.lit(0)
    )
    return F.when(own.isNotNull(), verdict(own)).when(star.isNotNull(), verdict(star)).otherwise("not-mentioned")


def crawler_status(site_files: DataFrame, crawlers=K.AI_CRAWLERS, case_insensitive: bool = False) -> DataFrame:
    """Status of every crawler per domain; a missing body allows everything.

    The crawler list is a fixed literal, so rows fan out in the projection.
    """
    parsed = site_files.select("domain", blocks("body").alias("b"))
    rows = parsed.select("domain", "b", F.explode(F.array(*[F.lit(x) for x in crawlers])).alias("crawler"))
    rule = F.when(F.col("b").isNull(), "not-mentioned").otherwise(agent_status(F.col("b"), F.col("crawler"), case_insensitive))
    return rows.select("domain", "crawler", rule.alias("status"), (rule == "blocked").alias("blocked"))


def bot_status_v1(site_files: DataFrame, bots=BOTS_V1) -> DataFrame:
    """The older rule: any non-empty Disallow blocks in a bot's own section.

    Sections start at each user-agent line; a mention anywhere in the body
    switches off the wildcard rule.
    """
    lines = _lines(F.col("body"))
    agents = F.transform(lines, lambda x: _value(x, "user-agent"))

    def scan(bot: Column, any_path: bool, wildcard: bool) -> Column:
        """Fold over lines: (inside, allow, deny, stop)."""

        def step(s, x):
            ua, allow, deny = _value(x, "user-agent"), _value(x, "allow"), _value(x, "disallow")
            mine = (ua == bot) | (ua == "*") if wildcard else ua == bot
            ended = s["stop"] | F.coalesce(~mine & ((s["allow"] | s["deny"]) if wildcard else s["inside"]), F.lit(False))
            live = s["inside"] & ~ended & ua.isNull()
            hit = F.coalesce((deny != "") if any_path else (deny == "/"), F.lit(False))
            return F.struct(
                F.when(ua.isNotNull(), mine).otherwise(s["inside"]).alias("inside"),
                (s["allow"] | (live & (allow.isNotNull() | F.coalesce(deny == "", F.lit(False))))).alias("allow"),
                (s["deny"] | (live & hit)).alias("deny"),
                ended.alias("stop"),
            )

        no = F.lit(False)
        zero = F.struct(no.alias("inside"), no.alias("allow"), no.alias("deny"), no.alias("stop"))
        return F.aggregate(lines, zero, step)

    rows = site_files.select("domain", "body", F.explode(F.array(*[F.lit(x) for x in bots])).alias("bot"))
    rows = rows.withColumn("own", scan(F.col("bot"), True, False)).withColumn("wild", scan(F.col("bot"), False, True))
    mentioned = F.col("body").contains(F.col("bot"))
    status = (
        F.when(F.coalesce(F.col("body"), F.lit("")) == "", "not-mentioned")
        .when(mentioned & F.col("own.deny") & ~F.col("own.allow"), "blocked")
        .when(mentioned & F.col("own.allow"), "allowed")
        .when(mentioned, "not-mentioned")
        .when(F.col("wild.deny") & ~F.col("wild.allow"), "blocked")
        .when(F.col("wild.allow"), "allowed")
        .otherwise("not-mentioned")
    )
    return rows.select("domain", "bot", status.alias("status"))


def sitemap_directive(body: Column | str) -> Column:
    return trim_ws(extract(c(body), r"(?im)^Sitemap:\s*([^\n]+)$"))


def bot_access_state(status: DataFrame) -> DataFrame:
    """Counts per domain and the three-way access state."""
    counts = status.groupBy("domain").agg(
        F.count_if(~F.col("blocked")).alias("allowed"), F.count_if("blocked").alias("blocked")
    )
    state = (
        F.when(F.col("allowed") == 0, "fully_blocked").when(F.col("blocked") > 0, "partially_blocked").otherwise("accessible")
    )
    return counts.withColumn("state", state)
