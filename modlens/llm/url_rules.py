"""URL filters: pattern rules indexed by their rarest literal token.

Main path: DataFrame functions only. Every distinct url is cut into its host and path and these
into tokens. A rule is found through one literal token that each url it fits must hold as a whole
token; of a rule's tokens the one rarest in the given urls is its index entry. The tokens of a url
fetch the few rules filed under them, and only those run their regular expression.

Host rules fit a host and its subdomains when the path starts with the rule's path; the longest
rule wins. Pattern rules are the method's own verdict on urls that no host rule fits.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed.
Repeated rows are judged alike and all returned. A rule without a whole literal token, or with
one that its expression does not require, is an error.
Two fitting rules of one length: the first in text order wins. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import lower_ascii, same_keys, table
from modlens.sources.tables import small_table

# (rule, verdict): the host, then the start of the path.
HOST_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
# (literal words that stand as whole tokens in each host that fits, regular expression of the host): blocked.
PATTERN_RULES = [
    (("casino", "win"), r"(^|[.-])casino-win([.-]|$)"),
    (("free",), r"(^|[.-])free-bets?([.-]|$)"),
    (("cheap", "pills"), r"(^|[.-])cheap-pills([.-]|$)"),
    (("spam", "farm"), r"(^|[.-])spam-farm([.-]|$)"),
    (("ads", "track"), r"(^|[.-])ads-track([.-]|$)"),
    (("adult",), r"(^|[.-])adult-[a-z0-9]+([.-]|$)"),
]


def host_of(url: Column) -> Column:
    """Host, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path up to the query or fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def tokens_of(address: Column) -> Column:
    """Distinct tokens of host + path: runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(address, "[^A-Za-z0-9]+"), lambda t: t != ""))


def required_tokens(pattern: str) -> set[str]:
    """Literals that each text the expression fits holds as whole tokens; none where that is not plain to see."""
    if re.search(r"\(\?[a-zA-Z]*[ix]", pattern):
        return set()
    rest = pattern.replace("(^|[.-])", "-").replace("([.-]|$)", "-")
    rest = re.sub(r"\\[.-]", "-", rest)
    # Other escapes, classes and groups stand for something unknown.
    rest = re.sub(r"\\.|\[[^\]]*\]", "\0", rest)
    while rest != (rest := re.sub(r"\([^()]*\)", "\0", rest)):
        pass
    return set() if "|" in rest else set(re.findall(r"(?<=-)[A-Za-z0-9]+(?=-(?![?*{]))", rest))


def rule_rows(
    host_rules: Sequence[tuple[str, str]], patterns: Sequence[tuple[Sequence[str], str]]
) -> list[tuple[str, str, str, bool, list[str]]]:
    """(rule, verdict, pattern of host + path, is a host rule, literal tokens)."""
    rows = []
    for rule, verdict in host_rules:
        host, _, path = rule.partition("/")
        # The last token of a path may be the start of a longer one, unless a sign ends it.
        whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", f"{host}/{path}")
        rows.append((rule, verdict, rf"(?s)^([^/]*\.)?{re.escape(host)}/{re.escape(path)}", True, whole))
    for words, pattern in patterns:
        if loose := set(words) - required_tokens(pattern):
            raise ValueError(f"rule {pattern} also fits without the tokens {sorted(loose)}")
        inside = pattern.replace("|$)", "|/|$)").replace("(^|[.-])", r"^([^/]*[.-])?")
        rows.append((pattern, "block", f"(?s){inside}", False, list(words)))
    for row in rows:
        if not row[4]:
            raise ValueError(f"no whole literal token in rule {row[0]}")
    return rows


def rule_index(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with ``token``: of their literals the one in the fewest addresses."""
    literal = rules.select("rule", F.explode("literals").alias("token"))
    seen = addresses.select(F.explode("tokens").alias("token"))
    found = seen.join(literal.select("token").distinct(), "token", "left_semi")
    counts = found.groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        literal.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return rules.drop("literals").join(rarest, "rule")


def judge(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str]] = HOST_RULES,
    patterns: Sequence[tuple[Sequence[str], str]] = PATTERN_RULES,
    url: str = "url",
) -> DataFrame:
    """The pages with host, path, rule (null where no host rule fits) and verdict."""
    spark = pages.sparkSession
    schema = "rule string, says string, pattern string, is_host boolean, literals array<string>"
    rules = small_table(spark, rule_rows(host_rules, patterns), schema)
    address = (
        pages.select(F.col(url).alias("_url"))
        .distinct()
        .select("_url", F.concat(host_of(F.col("_url")), path_of(F.col("_url"))).alias("address"))
        .withColumn("tokens", tokens_of(F.col("address")))
    )
    index = rule_index(address, rules)
    asked = address.select("_url", "address", F.explode("tokens").alias("token"))
    fits = asked.join(index, "token").filter(F.expr("address rlike pattern"))
    best = F.min(F.when(F.col("is_host"), F.struct((-F.length("rule")).alias("l"), "rule", "says")))
    found = fits.groupBy("_url").agg(
        best.alias("_best"), F.max(F.when(~F.col("is_host"), F.col("says"))).alias("_pattern")
    )
    out = same_keys(pages.withColumn("_url", F.col(url)), found, ["_url"], "left")
    return out.withColumns(
        {
            "host": host_of(F.col(url)),
            "path": path_of(F.col(url)),
            "rule": F.col("_best")["rule"],
            "verdict": F.coalesce(F.col("_best")["says"], F.col("_pattern"), F.lit("allow")),
        }
    ).drop("_url", "_best", "_pattern")


def op9(spark, folder):
    """Every page url judged."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (SELECT page_id,
   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
 r(rule, rule_host, rule_path, says) AS (VALUES ('net/', 'net', '/', 'block'),
   ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'),
   ('org/fr/', 'org', '/fr/', 'allow')),
 judged AS (SELECT page_id, host, path,
   (SELECT min(struct_pack(l := -length(rule), rule := rule, says := says)) FROM r
     WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
   FROM cut)
SELECT page_id, host, path, best.rule AS rule,
 coalesce(best.says, CASE WHEN regexp_matches(host,
   '(^|[.-])(casino-win|free-bets?|cheap-pills|spam-farm|ads-track|adult-[a-z0-9]+)([.-]|$)')
   THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
