"""URL allow and block rules as a sort-merge range join; DataFrame operations only.

A host is turned round label by label (``www.example.com`` becomes ``com\\0example\\0www\\0``, with NULs in labels escaped), so that a
host and all its subdomains are one interval of keys; so are a path and all that begin with it.  Such intervals nest or are apart.
Rules give boundary rows: where an interval begins and ends, each with the stack of what is active from there on.  Boundaries and
urls are sorted together and a window carries the latest stack down to each url.

There are two such sweeps.  The first finds which hosts with rules a url's host is under (one for each of its labels at most); the
second, for each of these, which of its paths the url's path begins with (one for each length at most).  The longest rule wins.

Work is dealt by top-level label, then by rule host.  Those with over one in ``HOT`` of all urls, so fewer than ``HOT`` of them, are dealt on by a salt:
their urls spread over the salts, and only their boundary rows are repeated for each, to a quarter of their urls at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT_VERDICT = "allow"
#: Labels with over one in so many of all urls are salted; about so many urls go to a salt.
HOT, SALT_ROWS = 1000, 5_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a NUL behind it; NULs inside labels are escaped, so none of them ends one."""
    plain = F.replace(F.replace(host, F.lit("\1"), F.lit("\1\1")), F.lit("\0"), F.lit("\1\2"))
    return F.concat(F.array_join(F.reverse(F.split(plain, "\\.")), "\0"), F.lit("\0"))


def top_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def host_boundaries(rules: DataFrame) -> DataFrame:
    """(part, key, stack): hosts with rules that hold from ``key`` on; ``part`` is the top-level label."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", "\\.")
    # a host and every parent, met by equality on the parent's name
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("over"))
    stacks = above.join(hosts.withColumnRenamed("host", "over"), "over").groupBy("host").agg(F.sort_array(F.collect_set("over")).alias("stack"))
    key = F.encode(host_key(F.col("host")), "UTF-8")
    return both_ends(stacks.select(top_label(F.col("host")).alias("part"), key.alias("key"), F.col("host").alias("own"), "stack"), lambda x, own: x == own)


def path_boundaries(rules: DataFrame) -> DataFrame:
    """(part, key, stack): rules (path, action) of a host (``part``) that hold from ``key`` on."""
    rules = rules.select("host", "path", "action").distinct()
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))
    # a path and every shorter one that it begins with, of the lengths that the host has
    above = rules.select("host", "path").distinct().join(sizes, "host").select("host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    above = above.select("host", "path", F.substring("path", F.lit(1), F.col("n")).alias("over"))
    met = above.join(rules.select("host", F.col("path").alias("over"), "action"), ["host", "over"])
    stacks = met.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct(F.col("over").alias("path"), "action"))).alias("stack"))
    return both_ends(stacks.select(F.col("host").alias("part"), F.encode("path", "UTF-8").alias("key"), F.col("path").alias("own"), "stack"), lambda x, own: x["path"] == own)


def both_ends(stacks: DataFrame, is_own) -> DataFrame:
    """An interval begins at its key with the whole stack, and ends behind all keys that begin so with what is left without its own entries."""
    past = F.concat("key", F.lit(b"\xff"))  # no text has this byte
    outside = F.filter("stack", lambda x: ~is_own(x, F.col("own")))
    return stacks.select("part", "key", "stack").unionByName(stacks.select("part", past.alias("key"), outside.alias("stack")))


def hot_parts(asked: DataFrame, marks: DataFrame, rows: int) -> dict[str, int]:
    """part -> salts of the parts that are salted, fewer than HOT.  Both tables are written ones."""
    urls = dict(asked.groupBy("part").count().where(F.col("count") > max(rows, asked.count() // HOT)).collect())
    if not urls:
        return {}
    boundaries = dict(marks.where(F.col("part").isin(list(urls))).groupBy("part").count().collect())
    salts = {part: min(-(-n // rows), n // (4 * boundaries[part])) for part, n in urls.items() if part in boundaries}
    return {part: n for part, n in salts.items() if n > 1}


def swept(asked: DataFrame, marks: DataFrame, salt_rows: int) -> DataFrame:
    """Adds the stack that holds at a row's key in its part, or null.  ``asked``: part, key and others; ``marks``: part, key, stack.  Both are written tables."""
    hot = hot_parts(asked, marks, salt_rows)
    salts = F.lit(1)
    if hot:
        salts = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("part")], salts)
        marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    else:
        marks = marks.withColumn("salt", F.lit(0))
    marks = marks.select("part", "salt", "key", F.lit(0).alias("kind"), "stack")
    dealt = asked.withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), salts).cast("int")).withColumn("kind", F.lit(1))
    sweep = Window.partitionBy("part", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.unionByName(marks, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
    return met.where("kind = 1").drop("salt", "kind", "part", "key")


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row for each row of ``urls``: id, host, path, rule, verdict.

    The rule with the most characters in host and path together wins, then the longer host, then the later action in the alphabet; rule is
    null and the verdict ``default`` where none fits.  Null urls and those without ``://`` have an empty
    host and path.  Repeated rows and null ids stay.  Other columns are ignored.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    asked = urls.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")).groupBy("id", "host", "path").agg(F.count("*").alias("times"))
    # urls are parsed once, however often their parts are counted
    asked = written(asked.withColumn("part", top_label(F.col("host"))).withColumn("key", F.encode(host_key(F.col("host")), "UTF-8")), "urls")
    hosts = swept(asked, written(host_boundaries(rules), "host-marks"), salt_rows)
    under = written(hosts.select("id", "host", "path", "times", F.explode_outer("stack").alias("part")), "url-hosts")
    found = swept(under.where("part IS NOT NULL").withColumn("over", F.col("part")).withColumn("key", F.encode("path", "UTF-8")), written(path_boundaries(rules), "path-marks"), salt_rows)
    ranked = F.transform("stack", lambda r: F.struct((F.length("over") + F.length(r["path"])).alias("n"), F.length("over").alias("h"), F.concat(F.col("over"), r["path"]).alias("rule"), r["action"].alias("action")))
    both = found.select("id", "host", "path", "times", F.array_max(ranked).alias("best")).unionByName(under.where("part IS NULL").drop("part"), allowMissingColumns=True)
    best = both.groupBy("id", "host", "path", "times").agg(F.max("best").alias("best"))
    rows = best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A few rules as a table of literals, whose size the planner knows."""
    rows = F.array(*[F.struct(F.lit(action).alias("action"), F.lit(host).alias("host"), F.lit(path).alias("path")) for action, host, path in rules])
    return spark.range(1).select(F.inline(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_table(spark))


SQL = f"""
WITH rules(action, host, path) AS (VALUES {", ".join(map(str, RULES))}),
cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (
  SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
best AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
         arg_max(r.action, length(r.host || r.path) * 1000 + length(r.host)) AS action
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT_VERDICT}') AS verdict FROM parsed LEFT JOIN best USING (n)
"""
