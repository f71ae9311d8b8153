"""URL rules as a sort-merge range join over reversed hosts.

A host's labels, reversed and each closed by a zero character, make a key under which
a domain and all its subdomains are one interval. The intervals of rules nest, so a
sweep in key order needs a stack: what it holds changes only where an interval opens
or closes. Here the rules' own sweep writes the stack down at each such place; pages
and places are sorted together, and every page takes the stack of the last place
before it. Of the stack the longest rule counts whose path the page's path starts
with. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Pages for which there is a part that is swept by itself.
PART_ROWS = 100_000
LEAST_PARTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z in lower case) after the first ``://`` and the path up to a query or fragment; both empty without one."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a zero character."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x00"), F.lit("\x00"))


def places(rules: DataFrame) -> DataFrame:
    """Where the stack of host rules changes: key and the rules that are active from there on, the longest first.

    ``rules`` has verdict, host and path. Size: at most twice the rules' hosts.
    """
    by_host = rules.groupBy("host").agg(F.collect_set(F.struct((-F.length(F.concat("host", "path"))).alias("rank"), (-F.length("host")).alias("deep"), "host", "path", (F.col("verdict") == "allow").alias("allows"))).alias("own"))
    spans = by_host.select(host_key(F.col("host")).alias("opens"), "own").withColumn("closes", F.concat(F.expr("left(opens, length(opens) - 1)"), F.lit("\x01")))
    at = spans.select(F.col("opens").alias("key")).unionByName(spans.select(F.col("closes").alias("key"))).distinct()
    # Rules only: each place and the intervals that hold it, which are those of its own prefixes.
    prefixes = F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    holding = at.select("key", F.explode_outer(F.filter(prefixes, lambda p: p.endswith("\x00"))).alias("opens")).join(spans.select("opens", "own"), "opens", "left")
    return holding.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, parts: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url).

    Other columns are ignored. A null url has an empty host and path; repeated rows
    each get a row. Of the rules that fit the longest by host and path wins, then
    that of the longer host, then the smaller host; of equal ones block beats allow.
    Rules with a null part fit nothing.
    Pages are dealt over as many parts as their number asks for, by their place in the
    input and not by what they hold, so a hot host and repeated rows are in all of
    them; each part sweeps with every place of the rules.
    """
    host, path = host_and_path(F.col("url"))
    parts = parts or max(LEAST_PARTS, -(-pages.count() // PART_ROWS))
    # The place only spreads rows; whatever part one falls in, its verdict is the same.
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"))
    swept = keyed.select("part", host_key(F.col("host")).alias("key"), F.lit(1).alias("turn"), "page_id", "host", "path")
    known = places(rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    opened = known.select("part", "key", F.lit(0).alias("turn"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    order = Window.partitionBy("part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    both = swept.withColumn("stack", F.lit(None).cast(opened.schema["stack"].dataType)).unionByName(opened)
    active = both.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("turn = 1")
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]) & ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))))
    best = F.get(fits, F.lit(0))
    return active.withColumn("best", best).select("page_id", "host", "path", F.concat(F.col("best.host"), F.col("best.path")).alias("rule"), F.when(F.col("best").isNull(), default).when(F.col("best.allows"), "allow").otherwise("block").alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + " AS rules(verdict, host, path)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


OP2_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT page_id, host, path, (SELECT arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict), length(rule_host || rule_path)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS b FROM parts)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best
"""
