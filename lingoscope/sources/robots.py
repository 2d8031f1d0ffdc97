"""robots.txt: parsing bodies and judging paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(bodies: DataFrame, run_col: str = "run_id", body_col: str = "body") -> DataFrame:
    """Rules of robots.txt bodies, a row each (see schema.ROBOTS).

    Consecutive agent lines open one group; rules before any agent and empty
    values are dropped; a pattern with ``?`` can't be judged on paths.
    """
    lines = bodies.select(F.col(run_col).alias("run_id"), F.posexplode(F.split(body_col, r"\r?\n")).alias("at", "raw"))
    text = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    field = F.lower(F.trim(F.regexp_extract(text, r"^([^:]+):", 1)))
    lines = lines.select("run_id", "at", F.trim("raw").alias("line"), field.alias("field"), F.trim(F.regexp_extract(text, r"^[^:]+:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow") & (F.col("value") != ""))
    order = Window.partitionBy("run_id").orderBy("at")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = lines.withColumn("group_ix", F.sum(opens.cast("int")).over(order)).where("group_ix > 0")
    agents = grouped.where("field = 'user-agent'").groupBy("run_id", "group_ix").agg(F.array_sort(F.collect_list(F.struct("at", F.lower("value").alias("agent")))).alias("a"))
    agents = agents.select("run_id", "group_ix", F.transform("a", lambda x: x["agent"]).alias("user_agents"))
    rules = grouped.where("field <> 'user-agent'").withColumn("rule_ix", F.row_number().over(Window.partitionBy("run_id", "group_ix").orderBy("at")) - 1)
    return rules.join(agents, ["run_id", "group_ix"]).select(
        "run_id", "group_ix", "user_agents", "rule_ix", F.col("field").alias("kind"), F.col("value").alias("pattern"), "line",
        (F.col("at") + 1).alias("line_number"), (~F.contains("value", F.lit("?"))).alias("evaluable"),
    )


def sitemaps(bodies: DataFrame, run_col: str = "run_id", body_col: str = "body") -> DataFrame:
    """(run_id, sitemap): what Sitemap lines name, wherever they stand."""
    lines = bodies.select(F.col(run_col).alias("run_id"), F.explode(F.split(body_col, r"\r?\n")).alias("raw"))
    return lines.select("run_id", F.trim(F.regexp_extract("raw", r"(?i)^\s*sitemap\s*:\s*([^#\s]+)", 1)).alias("sitemap")).where("sitemap <> ''").distinct()


def _bare(pattern: Column) -> Column:
    return F.when(F.endswith(pattern, F.lit("$")), F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)


def matcher(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: ``*`` is anything, a last ``$`` is the end."""
    quoted = F.array_join(F.transform(F.split(_bare(pattern), r"\*"), lambda part: F.when(part == "", part).otherwise(F.concat(F.lit(r"\Q"), part, F.lit(r"\E")))), ".*")
    return F.concat(F.lit("^"), quoted, F.when(F.endswith(pattern, F.lit("$")), F.lit("$")).otherwise(F.lit("")))


def head(pattern: Column) -> Column:
    """What every path that a pattern fits begins with: the letters before its first ``*``."""
    return F.substring_index(_bare(pattern), "*", 1)


def group_for(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of the group that addresses ``agent``: the longest name it begins with, else the first ``*``."""
    name = F.explode("user_agents").alias("name")
    named = rules.select("run_id", "group_ix", name).distinct()
    fits = (F.col("name") == "*") | F.startswith(F.lit(agent.lower()), F.col("name"))
    best = F.max_by("group_ix", F.struct(F.when(F.col("name") == "*", 0).otherwise(F.length("name")), -F.col("group_ix")))
    chosen = named.where(fits).groupBy("run_id").agg(best.alias("group_ix"), F.max_by("name", F.struct(F.when(F.col("name") == "*", 0).otherwise(F.length("name")), -F.col("group_ix"))).alias("agent"))
    return rules.join(chosen, ["run_id", "group_ix"])


def verdicts(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """For each (run_id, path, ...) the deciding rule: longest pattern, allow before disallow; default allowed.

    A path and a rule meet by the rule's head, so a path is tried against the rules that
    share its beginning and not against all of its run: a run's heads have few lengths,
    and a path is cut to each of them.  Only patterns with more than a head need their
    expression.
    """
    usable = rules.where("evaluable").select("run_id", "agent", "kind", "pattern", "line", "line_number", matcher(F.col("pattern")).alias("_matcher"), head(F.col("pattern")).alias("_head"), "rule_ix")
    lengths = usable.groupBy("run_id").agg(F.collect_set(F.length("_head")).alias("_lengths"))
    begun = paths.join(lengths, "run_id").withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("path")))).drop("_lengths")
    begun = begun.withColumn("_head", F.substring(F.col("path"), F.lit(1), F.col("_n"))).drop("_n")
    met = begun.join(usable, ["run_id", "_head"]).where("pattern = _head or path rlike _matcher")
    rank = F.struct(F.length("pattern"), (F.col("kind") == "allow").cast("int"), -F.col("rule_ix"))
    decided = met.groupBy(*paths.columns).agg(F.max_by(F.struct("kind", "pattern", "line", "line_number", "agent"), rank).alias("rule"))
    out = paths.join(decided, paths.columns, "left")
    return out.withColumn("allowed", F.coalesce(F.col("rule.kind") == "allow", F.lit(True)))
