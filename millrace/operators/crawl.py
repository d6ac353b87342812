"""What may be fetched, and when: robots.txt as data, and a plan with a budget for each host. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "struct<agents:array<string>,open:boolean,named:array<string>,rules:array<struct<agent:string,allow:boolean,pattern:string>>>"


def _groups(text: Column) -> Column:
    """A struct of the agents named in a robots.txt and the rules of each: lines are folded in their order."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:?", "")).alias("value")))
    wanted = F.filter(fields, lambda f: f["name"].isin("user-agent", "allow", "disallow"))
    empty = F.from_json(F.lit('{"agents":[],"open":false,"named":[],"rules":[]}'), _STATE)

    def step(state: Column, line: Column) -> Column:
        agent = F.array(F.lower(line["value"]))
        agents = F.when(state["open"], F.concat(state["agents"], agent)).otherwise(agent)  # lines in a row name one group
        new = F.transform(state["agents"], lambda a: F.struct(a.alias("agent"), (line["name"] == "allow").alias("allow"), line["value"].alias("pattern")))
        named = F.struct(agents.alias("agents"), F.lit(True).alias("open"), F.concat(state["named"], agent).alias("named"), state["rules"].alias("rules"))
        ruled = F.struct(state["agents"].alias("agents"), F.lit(False).alias("open"), state["named"].alias("named"), F.concat(state["rules"], new).alias("rules"))
        return F.when(line["name"] == "user-agent", named.cast(_STATE)).otherwise(ruled.cast(_STATE))

    return F.aggregate(wanted, empty, step)


def robots_rules(robots: DataFrame, host: str, text: str, agent: str) -> DataFrame:
    """host, allow, pattern: the rules that robots.txt files have for an agent; those for ``*`` where none names it.

    A rule without a path says nothing. Files are folded line by line in one expression.
    """
    read = robots.select(F.col(host).alias("host"), _groups(F.col(text)).alias("g"))
    mine = F.when(F.array_contains("g.named", agent.lower()), agent.lower()).otherwise("*")
    chosen = read.select("host", F.filter("g.rules", lambda r: (r["agent"] == mine) & (r["pattern"] != "")).alias("rules"))
    return chosen.select("host", F.inline("rules")).select("host", "allow", "pattern")


def _as_regex(pattern: Column) -> Column:
    """A path pattern, with * for anything and $ for the end, as a regular expression from the start."""
    ends = F.endswith(pattern, F.lit("$"))
    body = F.when(ends, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(ends, F.lit("$")).otherwise(F.lit("")))


def may_fetch(urls: DataFrame, id_col: str, host: str, path: str, rules: DataFrame) -> DataFrame:
    """urls with ``allowed``: by the longest rule of the host that fits the path (with its query), allowing ones first of equals; else yes.

    Rules are joined by host; those of a host are few, its URLs may be any number (Spark splits a hot host's).
    """
    fits = urls.select(F.col(id_col).alias("_id"), F.col(host).alias("_host"), F.col(path).alias("_path")).join(rules, F.col("_host") == F.col("host"))
    fits = fits.filter(F.rlike(F.col("_path"), _as_regex(F.col("pattern"))))
    best = fits.groupBy("_id").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("_best"))
    return urls.join(best, F.col(id_col) == F.col("_id"), "left").withColumn("allowed", F.coalesce("_best.allow", F.lit(True))).drop("_id", "_best")


def fetch_plan(urls: DataFrame, id_col: str, host: str, order: list[Column], budget: int = 12) -> DataFrame:
    """urls with ``slot``: the turn of each host's first ``budget`` allowed URLs; null for what isn't allowed or must wait.

    Slots are dealt round by round: slot 1 has one URL of each host, and so on. Of a host, each task keeps no more
    than the budget before the exchange.
    """
    turn = F.row_number().over(Window.partitionBy(host).orderBy(*order, F.col(id_col)))
    first = urls.filter("allowed").withColumn("slot", turn).filter(F.col("slot") <= budget).select(F.col(id_col).alias("_id"), "slot")
    return urls.join(first, F.col(id_col) == F.col("_id"), "left").drop("_id")
