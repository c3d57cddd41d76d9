"""URL filters: pattern rules indexed by their rarest literal token.

A rule (host, path, verdict) fits its host and all subdomains where the path
starts with the rule's. Its literal tokens are the labels of its host and those
segments of its path that a slash ends; every url that it fits has all of them.
Each rule is filed under one of its tokens only: the one that the fewest urls
have, counted over the whole table. A url fetches the rules filed under its own
tokens, and only for those is a regular expression run. The longest fitting rule
(host and path together; of equally long ones the one with the longer host)
decides; without one the default verdict holds.

Scale. DataFrame functions only. Token counts and the choice among fitting rules
are partial aggregates, so a host of a third of all urls is combined before the
shuffle; the choice is one long per url (lengths and verdict), from which the
rule's text is cut out of the url itself, so no rule travels through a shuffle.
Rules and index are written tables of known size, joined by Spark's own choice:
sent to all tasks while they are below the session's broadcast threshold, else by
a merge join, whose url side is a plain exchange that the skew rule can split; the
token that all urls share is dealt to ``SALTS`` keys. No list of rules is bounded
and nothing is collected.

Edge cases: a null url, or one without ``://``, has an empty host and path; only
a rule for every host can fit it. Empty and very long urls are urls like any
other. Repeated rows give a row each. An empty rule host fits every host; an
empty rule path every path; a rule path that does not begin with a slash fits
nothing. Of rules given twice with both verdicts, block holds; rules with a null
field or another verdict are left out. An empty table gives no rows, an empty
list of rules the default everywhere. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: The rules of the registered query.
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]
#: Token of the rules that have no literal one; every url has it, with one of so many numbers.
ANY, SALTS = "*", 256


def host_and_path(url: str) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url column; both empty without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def literal_tokens(host: Column, path: Column) -> Column:
    """Host labels and path segments that a slash ends, each once; the same for urls and rules."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    segments = F.split(path, "/")
    segments = F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0))), lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.filter(F.concat(labels, segments), lambda t: F.length(t) > 2))


def pattern(host: Column, path: Column) -> Column:
    """The regular expression of a rule over host and path joined."""
    def quoted(c):
        return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")

    return F.concat(F.lit("(?s)^"), F.when(host == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), quoted(host))),
                    F.lit(r"(?=/|\z)"), quoted(path))


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def indexed(rules: DataFrame, parts: DataFrame) -> DataFrame:
    """(token, pattern, weight): each rule under the token that the fewest of the urls (host, path) have.

    ``weight`` orders fitting rules: length of host and path, then of the host; its last bit is 1 for block.
    """
    known = rules.where(F.col("verdict").isin(ALLOW, BLOCK)).dropna(subset=["host", "path"])
    known = stored(known.groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("verdict")))
    tokens = known.select("r_host", "r_path", F.explode(literal_tokens(F.col("r_host"), F.col("r_path"))).alias("token"))
    seen = parts.select(F.explode(literal_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = seen.join(tokens.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (tokens.join(counts, "token", "left").groupBy("r_host", "r_path")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token")))
    size = (F.length("r_host") + F.length("r_path")).cast("long") * 2**32 + F.length("r_host") * 2
    anywhere = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.concat(F.lit(ANY), k.cast("string")))
    filed = F.when(F.col("token").isNull(), anywhere).otherwise(F.array("token"))
    return known.join(rarest, ["r_host", "r_path"], "left").select(
        F.explode(filed).alias("token"), pattern(F.col("r_host"), F.col("r_path")).alias("pattern"),
        (size + F.when(F.col("verdict") == BLOCK, 1).otherwise(0)).alias("weight"))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, key: str = "page_id", url: str = "url") -> DataFrame:
    """(``key``, host, path, rule, verdict) of every row."""
    host, path = host_and_path(url)
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    index = stored(indexed(rules, parts))
    # every url keeps one row of its own: the one with the token of rules that have none
    own = F.concat(F.lit(ANY), (F.col("_row") % SALTS).cast("string"))
    asked = (parts.withColumn("_row", F.monotonically_increasing_id())
             .select("*", F.explode(F.concat(F.array(own), literal_tokens(F.col("host"), F.col("path")))).alias("token")))
    met = asked.join(index, "token", "left").where((F.col("token") == own) | F.col("weight").isNotNull())
    text = F.concat("host", "path")
    weight = F.when(F.expr("regexp_like(concat(host, path), pattern)"), F.col("weight"))
    best = met.groupBy("_row", key, "host", "path").agg(F.max(weight).alias("weight"))
    n_host = F.shiftright(F.col("weight") % 2**32, 1).cast("int")
    n_both = F.shiftright("weight", 32).cast("int")
    start = F.length("host") - n_host + 1
    return best.select(
        key, "host", "path", F.when(F.col("weight").isNotNull(), F.substring(text, start, n_both)).alias("rule"),
        F.when(F.col("weight").isNull(), F.lit(default)).when(F.col("weight") % 2 == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every url of ``pages`` under ``RULES``; urls that no rule fits are allowed."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS row, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT row, page_id, split_part(split_part(split_part(rest, '#', 1), '?', 1), '/', 1) AS raw,
         split_part(split_part(rest, '#', 1), '?', 1) AS whole
  FROM u),
p AS (
  SELECT row, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, substr(whole, length(raw) + 1) AS path FROM h),
r (r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
f AS (
  SELECT p.row, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY p.row ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS place
  FROM p, r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.r_verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON f.row = p.row AND f.place = 1
"""
