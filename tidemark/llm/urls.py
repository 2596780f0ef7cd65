"""URL filters: rules are regular expressions over host and path, indexed by their rarest literal
token. A URL's tokens fetch the candidate rules, and only those run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ascii_lower, broadcast_parts, saved

#: The base rules (host, path, verdict).
BASE = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: The method's own patterns: regular expression over host and path, literal tokens that any URL which fits
#: holds whole, verdict. Words that stand alone between dots and hyphens of a host, and paths of whole segments.
HOST_WORDS = ["adult", "ads", "bets", "casino", "loans", "payday", "pharmacy", "pills", "poker", "porn", "slots", "spam", "xxx"]
PATTERNS = [(rf"^([^/]*[.-])?{w}[.-]", w, "block") for w in HOST_WORDS] + [
    (r"^([^/]*\.)?doubleclick\.net/", "doubleclick net", "block"),
    (r"/wp-login\.php$", "wp login php", "block"),
    (r"/wp-admin/", "wp admin", "block"),
    (r"/xmlrpc\.php$", "xmlrpc php", "block"),
    (r"/cgi-bin/", "cgi bin", "block"),
    (r"/cart/checkout(/|$)", "cart checkout", "block"),
    (r"/user/login(/|$)", "user login", "block"),
    (r"/search/results(/|$)", "search results", "block"),
    (r"/calendar/[0-9]{4}/[0-9]{1,2}(/|$)", "calendar", "block"),
] + [(rf"\.{w}$", w, "block") for w in ("apk", "dmg", "exe", "iso", "msi", "rar", "zip")]
#: Rows of the index up to which it is broadcast.
MOST_BROADCAST = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.char_length(u))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    after = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return ascii_lower(host), F.regexp_extract(after, r"\A[^?#]*", 0)


def prefix_rule(host: str, path: str) -> str:
    """The expression of a rule for a host, all its subdomains and a path's beginning."""
    quoted = re.sub(r"([^0-9A-Za-z_/\-])", r"\\\1", host), re.sub(r"([^0-9A-Za-z_/\-])", r"\\\1", path)
    return r"\A(?:[^/]*\.)?" + quoted[0] + quoted[1]


def literal_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL which fits a prefix rule holds whole: those of the host, and those of the
    path that a delimiter ends (the last one may go on in the URL)."""
    ended = re.sub(r"[0-9A-Za-z\u0080-\U0010ffff]*\Z", "", path)
    return [t for t in re.split(r"[^0-9A-Za-z\u0080-\U0010ffff]+", f"{host} {ended}") if t]


def rule_table(spark: SparkSession, base=BASE, patterns=PATTERNS) -> DataFrame:
    """``rule_no, rule, pattern, verdict, rank, tokens``. Rank: base rules by length, above all patterns."""
    rows = [(f"{h}{p}", prefix_rule(h, p), v, 1_000_000 + len(h) + len(p), literal_tokens(h, p)) for h, p, v in base]
    rows += [(None, p, v, len(p), t.split()) for p, t, v in patterns]
    bad = [r[1] for r in rows if not r[4]]
    if bad:
        raise ValueError(f"rules without a literal token: {bad}")
    return spark.createDataFrame(
        [(n, *r) for n, r in enumerate(rows)], "rule_no int, rule string, pattern string, verdict string, rank int, tokens array<string>"
    )


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(text, NOT_ALNUM))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for each row of ``pages``.

    The longest base rule that fits wins (of equally long ones the last in the table); without one the method's patterns decide (the longest that
    fits), else ``default``. rule is null unless a base rule fits. Null or malformed URLs have empty
    host and path and get ``default``. Repeated rows stay; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("at", F.concat("host", "path"))

    # the rarest of each rule's tokens, over all URLs; unseen ones count 0. Both sides are aggregated before they
    # meet, so no token is hot
    wanted = rules.select("rule_no", F.explode("tokens").alias("token"))
    tokens = urls.select(F.explode_outer(_tokens(F.col("at"))).alias("token"))
    asked = broadcast_parts(wanted.select("token").distinct(), ["token"], MOST_BROADCAST)
    counts = (tokens.join(asked[0], "token", "left_semi") if len(asked) == 1 else tokens).groupBy("token").count()
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_no").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    )
    index = rules.join(rarest, "rule_no").select("token", "rule_no", "rule", "pattern", "verdict", "rank")

    # a row for each token and one without, so that every URL is left with one at least
    parts = broadcast_parts(saved(index, "rules"), ["rule_no"], MOST_BROADCAST)
    numbered = urls.withColumn("row", F.monotonically_increasing_id())
    if len(parts) > 1:
        numbered = saved(numbered, "urls")  # so that the rows have the same numbers each time
    probes = numbered.select(
        "row", "page_id", "host", "path", "at", F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), _tokens(F.col("at")))).alias("token")
    )
    tried = None
    for part in parts:
        found = probes.join(part, "token", "left").where(F.col("token").isNull() | (F.col("pattern").isNotNull() & F.expr("regexp_like(at, pattern)")))
        tried = found if tried is None else tried.unionByName(found)
    best = F.max(F.when(F.col("rank").isNotNull(), F.struct("rank", "rule_no", "rule", "verdict", "pattern")))
    out = tried.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("b"))
    return out.select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("b.rule").isNull(), F.col("b.pattern")).alias("pattern"),
    )
