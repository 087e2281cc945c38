"""URL rules behind an index of literal tokens.

Every rule is a regular expression with the literal tokens it needs.  A rule is
indexed under its rarest token (the one in the fewest URLs).  The tokens of a
URL fetch candidate rules by an equi-join, and only those are run.

Site rules (``net/fr/``: a host with all subdomains, and a path prefix) become
such expressions over host and path; the longest one that fits decides.  Where
none fits, pattern rules decide: one that fits blocks, else the URL is allowed.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no site rule and is allowed unless a pattern fits it; repeated rows and
null ids are rows like any other; other columns are ignored; empty stays empty.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
              ("net/es/", "block"), ("net/fr/", "block"))
#: Pattern rules over the lower-cased URL; each blocks.
PATTERNS = (
    r"://[^/?#]*\bspam-farm\.", r"://[^/?#]*\bcheap-pills\.", r"://[^/?#]*\bcasino-bonus\b",
    r"://[^/?#]*\badult-[a-z]+\.", r"/wp-login\.php\b", r"[?&]sessionid=[0-9a-f]{8,}", r"/calendar/[0-9]{4}/[0-9]{2}/",
    r"[?&]replytocom=[0-9]+", r"\.exe\b", r"\.apk\b",
)
_TOKEN = r"[^a-z0-9]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def literal_tokens(pattern: str) -> list[str]:
    """Whole alphanumeric tokens that every match of a pattern holds.

    Only runs between literal separators at the top level count: groups, classes
    and optional parts are cut out first.
    """
    p = re.sub(r"\\.", lambda m: "\x01" if m.group()[1] in "./?-b" else "\x00", pattern)
    while re.search(r"\([^()]*\)", p):
        p = re.sub(r"\([^()]*\)[*+?]?", "\x00", p)
    p = re.sub(r"\[\^?([^\]]*)\](\{[^}]*\}|[*+?])?", lambda m: "\x01" if re.fullmatch(r"[^a-z0-9]+", m.group(1)) and not m.group(2) else "\x00", p)
    p = re.sub(r"[a-z0-9]\?", "\x00", p)
    found = []
    for m in re.finditer(r"[a-z0-9]+", p):
        before, after = p[m.start() - 1:m.start()], p[m.end():m.end() + 1]
        if before not in ("", "\x00") and after not in ("", "\x00"):
            found.append(m.group())
    return found


def site_pattern(rule: str) -> str:
    host, _, path = rule.partition("/")
    return "^([^/]*\\.)?" + re.escape(host) + re.escape("/" + path)


def rules(spark) -> DataFrame:
    """``(kind, rule, verdict, pattern, tokens)``; a pattern without a literal token has the empty token."""
    rows = [("site", r, v, site_pattern(r), [t for t in re.split(_TOKEN, r.lower()) if t]) for r, v in SITE_RULES]
    rows += [("pattern", p, "block", p, literal_tokens(p)) for p in PATTERNS]
    rows = [(k, r, v, p, t or [""]) for k, r, v, p, t in rows]
    return spark.createDataFrame(rows, "kind string, rule string, verdict string, pattern string, tokens array<string>")


def parts(url):
    """``(host, path)`` of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^?#]*", 0)
    host = F.translate(F.regexp_extract(rest, r"^[^/]*", 0), UPPER, LOWER)
    return host, F.substr(rest, F.length(host) + 1)


def verdicts(pages: DataFrame, rule_table: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, pattern)``, one row per input row."""
    rule_table = rules(pages.sparkSession) if rule_table is None else rule_table
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    urls = rows.where(F.col("url").isNotNull()).select("url", "host", "path").distinct()
    tokens = urls.select("url", "host", "path", F.explode(F.array_union(
        F.array_distinct(F.split(F.translate("url", UPPER, LOWER), _TOKEN)), F.array(F.lit("")))).alias("token"))
    # index: every rule under its token in the fewest URLs
    wanted = rule_table.select("rule", "kind", F.explode("tokens").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (wanted.join(seen, "token", "left").groupBy("rule", "kind")
              .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("token")))
    index = rule_table.drop("tokens").join(rarest, ["rule", "kind"])
    site = F.col("kind") == "site"
    subject = F.when(site, F.concat("host", "path")).otherwise(F.translate("url", UPPER, LOWER))
    fits = tokens.join(index, "token").withColumn("_subject", subject).where(F.expr("_subject rlike pattern"))
    by_length = F.struct(F.length("rule").alias("n"), F.col("rule"))
    best = fits.groupBy(F.col("url").alias("_url")).agg(
        F.max_by(F.when(site, F.col("rule")), F.when(site, by_length)).alias("rule"),
        F.max_by(F.when(site, F.col("verdict")), F.when(site, by_length)).alias("site_verdict"),
        F.min(F.when(~site, F.col("rule"))).alias("pattern"))
    judged = rows.join(best, F.col("url") == F.col("_url"), "left")
    method = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("site_verdict", method).alias("verdict"), "pattern")


def oracle() -> str:
    """DuckDB SQL of :func:`verdicts` for ``pages``: every rule against every URL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    sites = ", ".join(f"({q(r.partition('/')[0])}, {q('/' + r.partition('/')[2])}, {q(r)}, {q(v)})" for r, v in SITE_RULES)
    blocks = ", ".join(f"({q(p)})" for p in PATTERNS)
    low = f"translate(url, '{UPPER}', '{LOWER}')"
    return f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0
         THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest, {low} AS low FROM pages
), p AS (
  SELECT row_number() OVER () AS k, page_id, low, translate(regexp_extract(rest, '^[^/]*', 0), '{UPPER}', '{LOWER}') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*', 0)) + 1) AS path FROM u
), s(h, prefix, rule, verdict) AS (VALUES {sites}),
b(pattern) AS (VALUES {blocks}),
f AS (
  SELECT k, rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, rule DESC) AS r
  FROM p JOIN s ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix)
), g AS (SELECT k, min(pattern) AS pattern FROM p JOIN b ON regexp_matches(low, pattern) GROUP BY k)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN g.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, g.pattern
FROM p LEFT JOIN f ON f.k = p.k AND f.r = 1 LEFT JOIN g ON g.k = p.k"""
