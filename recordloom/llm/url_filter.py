"""URL filtering: a rule list first, then a path-template tree learnt per host.

``split_url`` and ``match_rules`` decide by host and path rules. ``template_verdicts``
builds the tree level by level from counts, for all hosts at once:

1. generalise: runs of digits become ``#``; at each node, segments that are mostly seen once
   (many distinct values against their rows) become the wildcard ``*``. A path has ``depth``
   levels: its segments from there on are one, so that no url makes the tree deeper;
2. merge: a branch whose labelled share of bad urls doesn't differ significantly from
   that of its siblings joins them in one branch ``~``;
3. judge: a template whose smoothed share of bad labels reaches ``reject_at`` is blocked. The
   prior is the same everywhere and low, so a template is blocked by labels of its own alone:
   one without labels is allowed, whatever its host's other templates are.

The state is one row per host and generalised path with its counts, summed on the map side. A
level's decisions are tables of exceptions (nodes that become wildcards, branches that merge);
they and the verdicts are joined with salted keys, so that a host, node or template with a third
of all rows goes to many tasks.

Cases: null urls and urls without ``://`` have host '' and path '' and fall under the
template of the empty host; repeated rows count as often as they stand; an empty table
gives an empty result; other columns are dropped, but for the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Levels of the tree; parts that a key's rows are dealt out in.
DEPTH, SALTS = 8, 16
#: (verdict, host, path prefix); a rule also fits subdomains.
Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path by the plain rule: after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end; then up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. Ties go to the later rule text."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    if not fits:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def shape_of(path: Column) -> Column:
    """The path with each run of digits as ``#``: what stays is small next to the rows."""
    return F.regexp_replace(path, r"\p{Nd}+", "#")


def _salted(big: DataFrame, small: DataFrame, keys: list[str], by: str, salts: int = SALTS) -> DataFrame:
    """``big`` left joined with ``small``, which has one row per key: a key's rows of ``big`` are
    dealt out by ``by``, and its row of ``small`` is repeated for each part."""
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def _level(groups: DataFrame, i: int, least_children: int, variable_at: float, z: float) -> DataFrame:
    """Generalise and merge segment ``i`` (from 1) of every template that has one."""
    deep = groups.filter(F.size("segments") >= i).withColumn("segment", F.element_at("segments", i))
    children = deep.groupBy("host", "prefix", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    nodes = children.groupBy("host", "prefix").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"node_{c}") for c in ("n", "labelled", "bad")]).filter("kinds > 1")
    wild = nodes.filter((F.col("kinds") >= least_children) & (F.col("kinds") >= variable_at * F.col("node_n"))).select("host", "prefix", F.lit(True).alias("wild"))
    both = _salted(children.filter("labelled > 0"), nodes, ["host", "prefix"], "segment").withColumns({"other_n": F.col("node_labelled") - F.col("labelled"), "other_bad": F.col("node_bad") - F.col("bad")})
    pooled = F.try_divide(F.col("node_bad"), F.col("node_labelled"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), F.col("other_n"))))
    gap = F.abs(F.try_divide(F.col("bad"), F.col("labelled")) - F.try_divide(F.col("other_bad"), F.col("other_n")))
    merged = both.filter((F.col("other_n") > 0) & ~(gap > z * error)).select("host", "prefix", "segment", F.lit(True).alias("merged"))
    named = _salted(_salted(deep, wild, ["host", "prefix"], "shape"), merged, ["host", "prefix", "segment"], "shape")
    name = F.when(F.col("wild"), "*").when(F.col("merged"), "~").otherwise(F.col("segment"))
    return named.withColumn("prefix", F.concat("prefix", F.lit("/"), name)).drop("segment", "wild", "merged")


def template_verdicts(urls: DataFrame, least_children: int = 20, variable_at: float = 0.5, z: float = 2.58, prior: float = 0.1, prior_weight: float = 8.0, reject_at: float = 0.5, depth: int = DEPTH) -> DataFrame:
    """``urls`` has host, path and bad (1, 0 or null where unlabelled), a row for each url.
    Returns host and ``shape`` (see ``shape_of``), once each, with template, purity (the
    smoothed share of bad labels) and verdict.

    Each level of the tree is one pass over the distinct generalised paths."""
    groups = urls.groupBy("host", shape_of(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    parts = F.filter(F.split("shape", "/"), lambda s: s != "")
    rest = F.array(F.array_join(F.slice(F.col("parts"), depth, F.greatest(F.size("parts"), F.lit(1))), "/"))
    segments = F.when(F.size("parts") > depth, F.concat(F.slice("parts", 1, depth - 1), rest)).otherwise(F.col("parts"))
    groups = cut(groups.withColumn("parts", parts).withColumns({"segments": segments, "prefix": F.lit("")}).drop("parts"), "url-shapes")
    deepest = groups.agg(F.max(F.size("segments"))).first()[0] or 0  # ``depth`` at most
    for i in range(1, deepest + 1):
        ended = groups.filter(F.size("segments") < i)
        groups = cut(ended.unionByName(_level(groups, i, least_children, variable_at, z)), f"url-level-{i}")
    judged = groups.groupBy("host", "prefix").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    purity = (F.col("all_bad") + prior_weight * prior) / (F.col("all_labelled") + prior_weight)
    judged = judged.select("host", "prefix", purity.alias("purity"), (F.col("all_labelled") > 0).alias("known"))
    return (
        _salted(groups, judged, ["host", "prefix"], "shape")
        .select("host", "shape", F.concat("host", "prefix").alias("template"), "purity", F.when(F.col("known") & (F.col("purity") >= reject_at), "block").otherwise("allow").alias("verdict"))
    )


def judged_urls(pages: DataFrame, key: str, url: str, rules: Sequence[Rule]) -> DataFrame:
    """key, host, path, rule, verdict (the rule's, else the template's), template and purity of each
    row. The rules' own verdicts are the labels that the tree learns from."""
    host, path = split_url(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    urls = pages.select(F.col(f"`{key}`").alias("_id"), host.alias("host"), path.alias("path")).withColumn("fit", match_rules(F.col("host"), F.col("path"), rules))
    learnt = template_verdicts(urls.select("host", "path", F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("long")).alias("bad")))
    found = _salted(urls.withColumns({"shape": shape_of(F.col("path")), "_row": F.xxhash64("_id", "path")}), learnt, ["host", "shape"], "_row")
    return found.select(F.col("_id").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "verdict").alias("verdict"), "template", "purity")
