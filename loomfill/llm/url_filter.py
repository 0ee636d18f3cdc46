"""URL filtering by host-suffix and path-prefix expressions, in native Spark operations.

Every distinct (host, path) is expanded into the expressions that some rule
could equal: host suffixes with as many labels as a rule's host, followed by
path prefixes as long as a rule's path. Expressions meet rules in an equi-join
on the first four bytes of their SHA-256; the full digests are compared after
the join, and the longest fitting rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfill.llm.common import UPPER, look_up, written

#: Fixed values: (action, rule) as the contract lists them.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Rule tables up to this many rows (about 20 MB) are broadcast; larger ones are shuffled.
BROADCAST_RULES = 100_000
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased;
    path: from there up to ``?`` or ``#``. Both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    cut = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(cut, "/", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.substring(cut, F.length(host) + 1, F.length(cut))


def _digests(rules: DataFrame) -> DataFrame:
    """Per rule: its text, verdict, shape (labels, path_len) and digest."""
    host = F.substring_index("rule", "/", 1)
    return rules.select(
        "rule",
        "action",
        F.length(host).alias("host_len"),
        F.size(F.split(host, r"\.")).alias("labels"),
        (F.length("rule") - F.length(host)).alias("path_len"),
        F.sha2("rule", 256).alias("full"),
        F.substring(F.sha2("rule", 256), 1, 8).alias("short"),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT,
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """Judge each row's url by ``rules(action, rule)``.

    Returns one row per input row: ``page_id, host, path, rule, verdict``.
    ``rule`` is host + path prefix, ``host/…``. It fits its host and all
    subdomains when the url's path starts with the rule's path. The longest
    rule wins; of equally long ones the longer host, then "block".
    Where no rule fits, ``rule`` is null and ``verdict`` is ``default``.
    Null urls and urls without ``://`` have empty host and path. Repeated rows
    are judged alike and all returned; empty tables give empty results, and an
    empty rule table the default everywhere. Urls of any length are judged
    whole; columns other than id and url are not read.
    """
    keyed = _digests(rules.where("rule IS NOT NULL").distinct())
    shapes = keyed.groupBy("labels", "path_len").agg(F.count(F.lit(1)).alias("n")).collect()  # label counts x path lengths
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Shapes are data, not expressions: a long list of rules makes the array longer, not the code.
    table = F.array(*[F.struct(F.lit(labels).alias("labels"), F.array(*[F.lit(s.path_len) for s in shapes if s.labels == labels]).alias("lengths")) for labels in sorted({s.labels for s in shapes})])
    longest = F.filter(table, lambda s: s["labels"] <= F.col("n_labels"))
    suffix = lambda s: F.array_join(F.slice("names", F.col("n_labels") - s["labels"] + 1, s["labels"]), ".")
    made = F.flatten(
        F.transform(
            longest,
            lambda s: F.transform(F.filter(s["lengths"], lambda n: n <= F.length("path")), lambda n: F.concat(suffix(s), F.substring(F.col("path"), F.lit(1), n))),
        )
    )
    pairs = judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_rows"))
    expressions = (
        pairs.withColumn("names", F.split("host", r"\."))
        .withColumn("n_labels", F.size("names"))
        .select("host", "path", "n_rows", F.explode_outer(F.array_distinct(F.when(F.col("host") != "", made))).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    small = sum(s.n for s in shapes) <= broadcast_rules
    hits = expressions.join(F.broadcast(keyed) if small else keyed, "short", "left")
    rank = F.when(F.col("digest") == F.col("full"), F.struct(F.length("rule").alias("len"), "host_len", (F.col("action") == "block").alias("b"), "rule", "action"))
    best = written(hits.groupBy("host", "path").agg(F.max(rank).alias("best"), F.max("n_rows").alias("n_rows")), "verdicts")
    return look_up(judged, best, ["host", "path"], "n_rows").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, rule string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP2_SQL = r"""
WITH r(action, rule) AS (
  VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')
), rr AS (
  SELECT action, rule, regexp_extract(rule, '^[^/]*') AS rhost, substr(rule, length(regexp_extract(rule, '^[^/]*')) + 1) AS rpath FROM r
), u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u
), d AS (SELECT DISTINCT host, path FROM h
), m AS (
  SELECT d.host, d.path, rr.rule, rr.action,
    row_number() OVER (PARTITION BY d.host, d.path ORDER BY length(rr.rule) DESC, length(rr.rhost) DESC) AS k
  FROM d JOIN rr ON (d.host = rr.rhost OR ends_with(d.host, '.' || rr.rhost)) AND starts_with(d.path, rr.rpath)
)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM h LEFT JOIN m ON m.host = h.host AND m.path = h.path AND m.k = 1
"""
