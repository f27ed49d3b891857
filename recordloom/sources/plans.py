"""Search plans and exported strategies as tables: a row for each strategy, from JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import normalize as N

# The fields of a plan.
_STRATEGY = "text string, query string, type string, subcommand string, sort string, source string, engine string, filters string, boolean_openalex string, boolean_ss string"
_PLAN = f"strategies array<struct<{_STRATEGY.replace(' string', ':string')}>>, queries array<struct<{_STRATEGY.replace(' string', ':string')}>>, year_min string, year_max string, year_range struct<min:string,max:string>, rank_filter struct<platform:string,tiers:array<string>,quartiles:array<string>,top:boolean>, work_type_filter string, search_topic string"


def _filled(*columns: str):
    return F.coalesce(*[N.blank_to_null(F.col(c)) for c in columns])


def strategies(plans: DataFrame, plan: str, json: str) -> DataFrame:
    """plan, place (from 0), text, type, source, filters and the two Boolean forms of each strategy of a
    plan, which is a JSON list of them or an object that holds them. An object's limits (years, journal
    ranks, work type) apply to all its strategies; one that has limits alone is a strategy itself."""
    is_list = F.trim(json).startswith("[")
    of_list, of_object = F.from_json(json, f"array<struct<{_STRATEGY.replace(' string', ':string')}>>"), F.from_json(json, _PLAN)
    rows = plans.select(F.col(plan).alias("plan"), is_list.alias("is_list"), F.when(is_list, of_list).alias("listed"), F.when(~is_list, of_object).alias("o"))
    low, high = F.coalesce("o.year_min", "o.year_range.min"), F.coalesce("o.year_max", "o.year_range.max")
    years = F.when(low.isNotNull() | high.isNotNull(), F.concat(F.lit("publication_year "), F.coalesce(low, F.lit("")), F.lit("-"), F.coalesce(high, F.lit(""))))
    ranks = F.array_join(F.when(F.size("o.rank_filter.tiers") > 0, F.col("o.rank_filter.tiers")).otherwise(F.coalesce("o.rank_filter.quartiles", F.array())), ",")
    top = F.when(F.col("o.rank_filter.top"), " top").otherwise("")
    ranked = F.when(_filled("o.rank_filter.platform").isNotNull(), F.concat(F.lit("journal rank: "), F.upper("o.rank_filter.platform"), top, F.lit(" "), ranks))
    kind = F.concat(F.lit("work type: "), N.blank_to_null(F.trim("o.work_type_filter")))
    rows = rows.withColumn("shared", F.array_compact(F.array(years, ranked, kind)))
    alone = F.when(F.size("shared") > 0, F.from_json(F.to_json(F.array(F.struct(F.coalesce("o.search_topic", F.lit("")).alias("text")))), f"array<struct<{_STRATEGY.replace(' string', ':string')}>>"))
    held = F.when(F.size("o.strategies") > 0, F.col("o.strategies")).when(F.size("o.queries") > 0, F.col("o.queries")).otherwise(alone)
    each = rows.select("plan", "shared", F.posexplode(F.coalesce(F.when(F.col("is_list"), F.col("listed")).otherwise(held), F.expr("array()"))).alias("place", "s")).filter("s is not null").select("plan", "shared", "place", "s.*")
    many = F.from_json("filters", "array<string>")
    own = F.when(F.startswith("filters", F.lit("[")), many).when(N.blank_to_null(F.col("filters")).isNotNull(), F.array("filters")).otherwise(F.array().cast("array<string>"))
    return each.select("plan", "place", F.coalesce(_filled("text", "query"), F.lit("")).alias("text"), _filled("type", "subcommand", "sort").alias("type"), _filled("source", "engine").alias("source"), F.concat(own, "shared").alias("filters"), "boolean_openalex", "boolean_ss")


def expressions(planned: DataFrame, exported: DataFrame) -> DataFrame:
    """What the method log lists for each plan: the planned strategies and the exported ones (plan,
    platform, host, expression, limits, filter, status). An exported strategy without an expression was
    withheld and is listed as such."""
    own = planned.select("plan", F.lit("planned").alias("origin"), F.col("source").alias("host"), N.blank_to_null(F.col("text")).alias("expression"), F.array_join("filters", "; ").alias("limits"), F.lit(None).cast("string").alias("filter"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("withheld"))
    more = exported.select("plan", F.lit("exported").alias("origin"), F.coalesce("host", "platform").alias("host"), "expression", "limits", "filter", "status", F.col("expression").isNull().alias("withheld"))
    return own.unionByName(more)
