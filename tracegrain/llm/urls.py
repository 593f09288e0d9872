"""URL filters: pattern rules indexed by their rarest literal token; tokens fetch the rules whose patterns run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's rules, as (kind, host, path, verdict).
CONTRACT = [("site", "com", "/", "allow"), ("site", "example.com", "/en/", "block"), ("site", "www.example.com", "/en/", "allow"), ("site", "net", "/es/", "block"), ("site", "net", "/fr/", "block")]
#: The method's own rules where no rule of the contract fits: hosts that call themselves so, and folders of advertisement.
OWN = [("host word", w, "", "block") for w in ("spam", "pills", "casino", "poker", "viagra", "malware", "phishing", "warez")] + [
    ("folder", "", w, "block") for w in ("adserver", "affiliate", "banners", "doubleclick", "popunder", "tracker")
]
RULE = "kind string, host string, path string, verdict string"
#: A site rule ranks by its length above every rule of the other kinds.
SITE_RANK, HOST_RANK, FOLDER_RANK = 1000, 10, 5


def _quoted(text: Column) -> Column:
    """A pattern for just this text."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def compile_rules(rules: DataFrame) -> DataFrame:
    """rule (its name), pattern, tokens, verdict and rank of each row of ``rules`` (kind, host, path, verdict), a table of any size.

    A ``site`` rule fits its host (empty: every host) and all subdomains where the path starts with its path (empty: every path); a longer one
    ranks higher. A ``host word`` is a whole word of the host, a ``folder`` a whole folder of the path. Hosts are lower-cased
    (A-Z), paths are compared as they are. ``tokens`` are the literal tokens that a url must have to fit: a token at a site's path's
    end may go on in the url, so it is none; a rule without tokens is tried on every url. Null host or path is empty. No rule: a null
    verdict, another kind, an empty word or folder, a site with ``/``, ``?`` or ``#`` in its host. Repeated rules count once; further columns are not looked at.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    site, word, folder = (F.col("kind") == k for k in ("site", "host word", "folder"))
    heads = F.regexp_extract_all(F.lower(path), F.lit("([a-z0-9]+)(?=[^a-z0-9])"), F.lit(1))
    pattern = (
        F.when(site, F.concat(F.when(host == "", "^[^/]*").otherwise(F.concat(F.lit("^(?:[^/]*\\.)?"), _quoted(host))), F.lit("(?=/|$)"), _quoted(path)))
        .when(word, F.concat(F.lit("^[^/]*\\b"), _quoted(host), F.lit("\\b[^/]*(?:/|$)")))
        .when(folder, F.concat(F.lit("^[^/]*/(?:.*/)?"), _quoted(path), F.lit("/")))
    )
    tokens = F.when(site, F.concat(_tokens(host), heads)).when(word, _tokens(host)).otherwise(_tokens(path))
    name = F.when(site, F.concat(host, path)).when(word, F.concat(F.lit("~"), host)).otherwise(F.concat(F.lit("~/"), path, F.lit("/")))
    rank = F.when(site, F.lit(SITE_RANK) + F.length(host) + F.length(path)).when(word, HOST_RANK).otherwise(FOLDER_RANK)
    named = rules.where((site & ~F.regexp_like(host, F.lit("[/?#]")) | (word & (host != "")) | (folder & (path != ""))) & F.col("verdict").isNotNull())
    return named.select(name.alias("rule"), pattern.alias("pattern"), F.array_distinct(tokens).alias("tokens"), "verdict", rank.alias("rank")).distinct()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """A few rules as rows (kind, host, path, verdict) of literals, whose size Spark knows, so that it broadcasts them only if they are small."""
    rows = [F.struct(*[F.lit(x).alias(c.split()[0]) for x, c in zip(r, RULE.split(", "), strict=True)]) for r in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with ``token``, the one of their literal tokens that fewest urls have (``tokens``: one row for each
    url and token). A rule without literal tokens has the token ``""``, which every url is given."""
    named = rules.select("pattern", F.explode("tokens").alias("token")).distinct()
    seen = tokens.join(named.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = named.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("pattern").agg(F.min(F.struct("n", "token")).alias("best")).select("pattern", F.col("best.token").alias("token"))
    return rules.join(best, "pattern", "left").select("rule", "pattern", "verdict", "rank", F.coalesce("token", F.lit("")).alias("token"))


def candidate_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, pattern, verdict, rank for every one of the different ``urls`` (host, path) and each compiled rule
    that is indexed under one of the url's tokens: what patterns are tried on."""
    text = F.concat("host", "path")
    each = urls.select("host", "path", F.explode(F.concat(F.array(F.lit("")), _tokens(text))).alias("token"))
    return each.join(index_rules(rules, each.where(F.col("token") != "").select("token")), "token").drop("token")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path and ``hit`` (rank, rule, verdict of the highest rule that fits, else null) for every row of ``pages``
    (page_id, url) under the compiled ``rules``.

    Each different host and path is tried once: its tokens fetch the rules indexed under them, and only those patterns
    run. Rows get their hit by a join, which Spark splits where very many rows have one url. Null urls and urls without
    ``://`` have an empty host and path; equal rows each get a row; of rules with equal rank the greater name wins, and of
    those with one name the greater verdict; an empty table gives an empty one; other columns are not looked at.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    tried = candidate_rules(urls.select("host", "path").distinct(), rules).where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    found = tried.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("hit"))
    return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", "hit")


def url_verdicts(pages: DataFrame) -> DataFrame:
    """Every page's verdict under the contract's rules, and the method's own where none of them fits; nulls, equal rows,
    ties and empty tables as judge_urls() says."""
    spark = pages.sparkSession
    found = judge_urls(pages, compile_rules(rule_table(spark, CONTRACT + OWN)))
    mine = F.col("hit.rank") >= SITE_RANK
    return found.select("page_id", "host", "path", F.when(mine, F.col("hit.rule")).alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit("allow")).alias("verdict"))
