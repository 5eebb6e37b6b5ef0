"""URL filters by expression expansion and short hash prefixes.

A URL is expanded into host suffixes x path prefixes (the path cut after each
``/``).  Expressions and rules meet in an equi-join on 32 bits of their SHA-256
digest; the full digest, the rule's whole path and precedence decide after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule table of at most this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 20_000


def url_parts(url):
    """(host, path): host after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (block or allow).  A rule fits its host
    and all subdomains if the URL's path starts with the rule's path; the longest
    host + path wins, then the longer host, then block.  A URL that no rule fits
    gets ``default`` and a null rule.  Null URLs and URLs without ``://`` have
    empty parts.  Rules with a null or empty host fit nothing; a null path counts
    as empty.  Repeated rules and repeated pages are kept harmless: each page row
    comes back once.  Empty tables give empty results or defaults.  Other columns
    are not read.
    """
    key = F.xxhash64(F.col(id_col), F.col(url))
    host, path = url_parts(F.col(url))
    rows = pages.select(key.alias("row_key"), F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    r = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host <> '' and r_verdict is not null")
    stem = F.regexp_extract("r_path", r"(?s)^.*/", 0)
    r = r.withColumn("digest", _digest(F.col("r_host"), stem)).withColumn("short", F.substring("digest", 1, 8))
    shape = r.agg(F.count("*").alias("n"), F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.length(F.regexp_replace(stem, "[^/]", ""))).alias("depth")).first()
    if not shape.n:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    count = F.least(F.size(labels), F.lit(shape.labels))
    hosts = F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    depth = F.least(F.size(parts) - 1, F.lit(shape.depth))
    stems = F.when(depth < 1, F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))))
    expressions = rows.where("host <> ''").select("row_key", "path", F.explode(hosts).alias("e_host"), stems.alias("stems")).select("row_key", "path", "e_host", F.explode("stems").alias("e_stem"))
    expressions = expressions.select("row_key", "path", _digest(F.col("e_host"), F.col("e_stem")).alias("e_digest")).withColumn("short", F.substring("e_digest", 1, 8))
    near = F.broadcast(r) if shape.n <= BROADCAST_RULES else r
    fits = expressions.join(near, "short").where("digest = e_digest and startswith(path, r_path)")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").alias("c"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("v"))
    best = fits.groupBy("row_key").agg(F.max(rank).alias("best"))
    return rows.join(best, "row_key", "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
