"""URL filters: pattern rules indexed by their rarest literal token.

Every rule has literal tokens: runs of ``[a-z0-9%]`` that its pattern bounds
on both sides, so a URL that fits the rule has each of them as a whole token.
A rule is stored under that one of its tokens which is rarest in the URLs at
hand.  The tokens of a URL fetch candidate rules by an equi-join, and regular
expressions run on those candidates only.  Built-in expressions throughout.

Rule kinds:

* ``site``: host and path, as ``example.org/es/``.  It fits the host and all
  its subdomains if the path starts with the rule's path.
* ``pattern``: over the URL with A-Z lower-cased; ``*`` is any run, ``^`` a
  separator or the end, a leading ``||`` the start of the host or of one of
  its labels, a leading or trailing ``|`` the start or the end of the URL.

The longest fitting site rule decides (of equally long ones a block rule,
then the first in string order); without one, a fitting allow pattern, then a
fitting block pattern, then ``default``.

Defined cases: a null URL or one without ``://`` has empty host and path and
gets the default or a pattern's verdict; repeated rows stay repeated; an
empty table gives an empty result; rules without a bounded token are tried on
every URL; other columns of the input are not read, so their names can't
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import ascii_lower, literal_rows

RULE_COLUMNS = ["kind", "pattern", "verdict"]

#: Rules given as a Python list up to this many are broadcast; their number bounds the size.
BROADCAST_RULES = 200_000

SITE_RULES = [
    ("site", "org/", "allow"),
    ("site", "example.org/es/", "block"),
    ("site", "example.org/en/1", "block"),
    ("site", "com/fr/", "allow"),
    ("site", "com/de/", "block"),
]

#: What the method itself blocks: addresses of advertisements and trackers.
PATTERN_RULES = [
    ("pattern", "||ads.", "block"),
    ("pattern", "||adserver.", "block"),
    ("pattern", "||tracker.", "block"),
    ("pattern", "/adserver/", "block"),
    ("pattern", "/banner/*/click^", "block"),
    ("pattern", "/popunder.", "block"),
    ("pattern", "/pixel.gif|", "block"),
]

_TOKEN = "[a-z0-9%]+"


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """(kind, pattern, verdict) rows as a table."""
    if not rules:
        return literal_rows(spark, RULE_COLUMNS, [("site", "", "allow")]).where(F.lit(False))
    return literal_rows(spark, RULE_COLUMNS, rules)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Adds ``regex`` and ``tokens``, the bounded literal tokens, to (kind, pattern, verdict)."""
    site = F.col("kind") == "site"
    quoted = F.regexp_replace("pattern", r"([\\.$+?()\[\]{}])", r"\\$1")
    site_regex = F.concat(F.lit(r"\A[^/]*\."), F.regexp_replace(quoted, r"([*^|])", r"\\$1"))
    core = F.regexp_replace(F.regexp_replace(quoted, r"\A\|\|", ""), r"\A\||\|\z", "")
    core = F.regexp_replace(core, r"\|", r"\\|")
    core = F.regexp_replace(F.regexp_replace(core, r"\*", r".*"), r"\^", r"(?:[^a-z0-9_.%-]|\\z)")
    head = (F.when(F.col("pattern").startswith("||"), F.lit(r"\A[^:/?#]*://(?:[^/?#]*\.)?"))
            .when(F.col("pattern").startswith("|"), F.lit(r"\A")).otherwise(F.lit("")))
    tail = F.when(F.col("pattern").endswith("|"), F.lit(r"\z")).otherwise(F.lit(""))
    literal = F.when(site, F.concat(F.lit("."), ascii_lower(F.col("pattern")))).otherwise(F.col("pattern"))
    bounded = f"(?<=[^a-z0-9%*]){_TOKEN}(?=[^a-z0-9%*])"
    return rules.select(
        "kind", "pattern", "verdict",
        F.when(site, site_regex).otherwise(F.concat(F.lit("(?s)"), head, core, tail)).alias("regex"),
        F.array_distinct(F.regexp_extract_all(literal, F.lit(bounded), F.lit(0))).alias("tokens"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple], id_col: str = "page_id",
                url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, pattern (the fitting pattern, if that decided)."""
    spark = pages.sparkSession
    small = isinstance(rules, list) and len(rules) <= BROADCAST_RULES
    compiled = compile_rules(rule_table(spark, rules) if isinstance(rules, list) else rules)
    hint = F.broadcast if small else (lambda df: df)

    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = base.select("url").where(F.col("url").isNotNull())
    tokens = urls.select(
        "url", F.explode(F.array_append(F.array_distinct(
            F.regexp_extract_all(ascii_lower(F.col("url")), F.lit(_TOKEN), F.lit(0))), F.lit(""))).alias("token"))

    # rarest token of a rule in these URLs; "" for rules without one
    rule_tokens = compiled.select("kind", "pattern", "verdict", "regex", F.explode_outer("tokens").alias("token"))
    known = rule_tokens.select("token").where(F.col("token").isNotNull()).distinct()
    seen = tokens.join(hint(known), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (rule_tokens.join(hint(seen) if small else seen, "token", "left")
             .groupBy("kind", "pattern", "verdict", "regex")
             .agg(F.min_by(F.coalesce("token", F.lit("")),
                           F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit("")))).alias("token")))

    subject = F.when(F.col("kind") == "site", F.concat(F.lit("."), url_host(F.col("url")), url_path(F.col("url")))
                     ).otherwise(ascii_lower(F.col("url")))
    fits = (tokens.join(hint(index), "token").where(F.rlike(subject, F.col("regex"))))
    length = F.length("pattern")
    blocks_first = (F.col("verdict") == "block").cast("int")
    ruled = fits.groupBy("url").agg(
        F.min_by(F.struct("pattern", "verdict"), F.when(
            F.col("kind") == "site", F.struct(-length, -blocks_first, F.col("pattern")))).alias("site"),
        F.min_by(F.struct("pattern", "verdict"), F.when(
            F.col("kind") != "site", F.struct(F.col("verdict"), -length, F.col("pattern")))).alias("other"),
    )
    return base.join(ruled, "url", "left").select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("site.pattern").alias("rule"),
        F.coalesce("site.verdict", "other.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("other.pattern")).alias("pattern"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, SITE_RULES + PATTERN_RULES)


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, url, lower(url) AS low,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
p AS (
  SELECT page_id, low,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
r(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT page_id, p.host, p.path,
         max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(r.verdict, length(rule_host || rule_path)) AS site_verdict,
         any_value(low) AS low
  FROM p LEFT JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY page_id, p.host, p.path),
g AS (
  SELECT *, CASE
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?ads\.') THEN '||ads.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?adserver\.') THEN '||adserver.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?tracker\.') THEN '||tracker.'
    WHEN regexp_matches(low, '/adserver/') THEN '/adserver/'
    WHEN regexp_matches(low, '/banner/.*/click([^a-z0-9_.%-]|$)') THEN '/banner/*/click^'
    WHEN regexp_matches(low, '/popunder\.') THEN '/popunder.'
    WHEN regexp_matches(low, '/pixel\.gif$') THEN '/pixel.gif|' END AS hit
  FROM f)
SELECT page_id, host, path, rule,
       coalesce(site_verdict, CASE WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS pattern
FROM g
"""
