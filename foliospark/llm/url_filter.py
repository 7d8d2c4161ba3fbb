"""URL filters: host-suffix and path-prefix expressions, matched on short hash prefixes, confirmed by full digests.

A rule is host + path (`example.com/en/7`): it fits its host and all
subdomains if the URL's path starts with the rule's path; the longest rule
wins (then the smaller string).  Host: after the first `://` up to `/`, `?`,
`#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.  A null
URL or one without `://` has an empty host and path and fits no rule; the
verdict without a rule is the default.  Repeated URLs and ids each get their
row, an empty table gives none, and only the id and the URL are read of it.

Paths are cut only at the lengths that rules have, so the expressions of a URL
are (labels of its host) x (rule path lengths), however long the URL is.
All of it is native; the rule table is broadcast only below RULE_BYTES.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, rule)
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
HASH_CHARS = 8
RULE_BYTES = 32 << 20


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Columns rule, verdict, short, digest. Repeated rules: the first counts."""
    first: dict[str, str] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        first.setdefault(rule, verdict)
    # an Arrow table stays in the JVM: no Python workers
    df = spark.createDataFrame(pa.table({"rule": pa.array(list(first), pa.string()), "rule_verdict": pa.array(list(first.values()), pa.string())}))
    digest = F.sha2("rule", 256)
    return df.select("rule", "rule_verdict", F.substring(digest, 1, HASH_CHARS).alias("short"), digest.alias("digest"))


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns({
        "host": ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)),
        "path": F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1),
    })


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (or null), verdict."""
    spark = df.sparkSession
    lengths = sorted({len(r) - r.index("/") for _, r in rules})
    table = rule_table(spark, rules)
    if sum(len(r.encode()) for _, r in rules) < RULE_BYTES:
        table = F.broadcast(table)
    urls = split_url(df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.monotonically_increasing_id().alias("_row")), "_url").drop("_url")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(cuts, lambda n: F.concat(h, F.expr("path").substr(F.lit(1), n)))))
    own = F.struct("_id", "host", "path")
    keyed = urls.select(own.alias("own"), "_row", F.explode_outer(expressions).alias("_expr"))
    digest = F.sha2("_expr", 256)
    keyed = keyed.select("own", "_row", digest.alias("_digest"), F.substring(digest, 1, HASH_CHARS).alias("_short"))
    # short prefixes meet first; then full digests confirm, and what they confirm is ranked
    hit = keyed.join(table, F.col("_short") == F.col("short"), "left")
    order = F.when(F.col("_digest") == F.col("digest"), F.struct(-F.length("rule"), F.col("rule")))
    best = hit.groupBy("_row", "own").agg(F.min_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    return best.select(
        F.col("own._id").alias(id_col), "own.host", "own.path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
