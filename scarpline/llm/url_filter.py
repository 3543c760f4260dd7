"""URL filters from hash-prefix lists, from DataFrame functions alone.

A rule names a host, a path and an action. It fits URLs of its host and of all its subdomains whose path starts with the rule's; of the
rules that fit, the longest decides (by characters of host and path together, then of the host; a rule given twice blocks if one of them
does). URLs that no rule fits get ``default``.

Each different URL is expanded into the expressions that a rule could have: suffixes of the host at label bounds, each with prefixes of the
path, as ``host + path``. Only lengths of hosts and paths that occur together in a rule are expanded, so a long URL makes no more rows than
the rules have such pairs. Expressions and rules meet in a join on the first bytes of their SHA-256; those that meet are confirmed by the
whole digest, and the longest is taken for each URL.

Up to ``broadcast_rules`` rules, by their count, are broadcast. More are joined by shuffle, and no key is then joined whole if it is hot:
prefixes that hold more than one in ``HOT`` of all expressions are counted first; there are at most ``HOT`` of them, so their rules are
broadcast. The verdicts of different URLs go back to the rows in the same way, so a URL of a third of all rows is not shuffled.

The host is what stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case; the path is what follows up to
``?`` or ``#``. A null URL or one without ``://`` has an empty host and path. URLs may have any length. Repeated rows each get their verdict.
A rule with a null host, path or action, and an action other than allow or block, is an error. Without rules all get the default; an
empty table gives an empty table. Rules whose host holds ``/``, ``?`` or ``#`` or whose path doesn't begin with ``/`` (or is empty) fit
nothing. Input columns named host, path, rule, verdict, key or action are left out or replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, saved

#: A key is hot if it has more than one row in so many; so there are no more hot keys than this.
HOT = 1000
ACTIONS = ("allow", "block")


def host_of(url: Column) -> Column:
    """The host in lower case; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """The path with its first slash; empty if the host ends the URL or a query follows it."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))


def digest(expression: Column) -> Column:
    """The 32 bytes of an expression's SHA-256."""
    return F.unhex(F.sha2(expression, 256))


def _lengths(rules: DataFrame) -> dict[int, list[int]]:
    """Lengths of hosts, and for each those of the paths that rules have with it; as many numbers as there are different pairs."""
    out: dict[int, list[int]] = {}
    for r in rules.select(F.length("host").alias("h"), F.length("path").alias("p")).distinct().orderBy("h", "p").collect():
        out.setdefault(r["h"], []).append(r["p"])
    return out


def expressions(host: Column, path: Column, lengths: dict[int, list[int]]) -> Column:
    """The expressions of a URL, an array of strings: host suffixes at label bounds with path prefixes, of the given lengths."""
    known = F.create_map(*(F.lit(x) for h, ps in lengths.items() for x in (h, ps)))
    n, m = F.length(host), F.length(path)
    bounded = F.filter(F.map_keys(known), lambda h: (h == n) | ((h < n) & (F.substring(host, n - h, F.lit(1)) == ".")))

    def of(h: Column) -> Column:
        fitting = F.filter(F.element_at(known, h), lambda p: p <= m)
        return F.transform(fitting, lambda p: F.concat(F.substring(host, n - h + 1, h), F.substring(path, F.lit(1), p)))

    return F.flatten(F.transform(bounded, of))


def _checked(rules: DataFrame) -> DataFrame:
    """Rules with host, path and action, each once; those given twice block if one of them does."""
    plain = rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("action"))
    bad = plain.where(F.col("host").isNull() | F.col("path").isNull() | F.col("action").isNull() | ~F.col("action").isin(*ACTIONS)).limit(5).collect()
    if bad:
        raise ValueError(f"Rules without host, path or a known action: {[tuple(r) for r in bad]}")
    able = ~F.col("host").rlike("[/?#]") & ((F.col("path") == "") | F.col("path").startswith("/"))
    return plain.where(able).groupBy("host", "path").agg(F.max("action").alias("action"))  # block is after allow


def _hot_join(rows: DataFrame, table: DataFrame, key: str, hot: list, how: str) -> DataFrame:
    """rows joined with table; keys in ``hot`` by a broadcast of their part of the table, the others by shuffle."""
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(table.where(~is_hot), key, how).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how))


def _hot_keys(counts: DataFrame, key: str) -> list:
    """Keys of a table of key and n that hold more than one row in HOT: HOT keys at most."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return [r[key] for r in counts.where(F.col("n") > max(1, total // HOT)).select(key).collect()]


def verdicts(urls: DataFrame, rules: DataFrame, prefix_bytes: int = 4, broadcast_rules: int = 100_000) -> DataFrame:
    """key, rule, action for each URL that a rule fits. urls: key (unique), host, path; rules: host, path, action."""
    rules = saved(_checked(rules), "rules")
    lengths = _lengths(rules)
    if not lengths:
        return urls.select("key", F.lit("").alias("rule"), F.lit("").alias("action")).limit(0)
    listed = rules.withColumn("rule", F.concat("host", "path")).select("rule", "action", F.length("host").alias("_host"), digest(F.col("rule")).alias("_full"))
    listed = listed.withColumn("prefix", F.substring("_full", 1, prefix_bytes))
    spread = urls.select("key", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
    spread = spread.select("key", digest(F.col("expression")).alias("digest")).withColumn("prefix", F.substring("digest", 1, prefix_bytes))
    if rules.count() <= broadcast_rules:
        met = spread.join(F.broadcast(listed), "prefix")
    else:
        met = _hot_join(spread, listed, "prefix", _hot_keys(spread.groupBy("prefix").agg(F.count("*").alias("n")), "prefix"), "inner")
    order = F.struct(F.length("rule").alias("n"), F.col("_host").alias("h"))
    confirmed = met.where(F.col("digest") == F.col("_full"))
    return confirmed.groupBy("key").agg(F.max_by(F.struct("rule", "action"), order).alias("won")).select("key", "won.rule", "won.action")


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", **options) -> DataFrame:
    """Every row with host, path, rule (null if none fits) and verdict."""
    if default not in ACTIONS:
        raise ValueError(f"default: one of {ACTIONS}")
    key = digest(F.concat("host", "path"))  # a path is empty or begins with what no host holds
    added, taken = {"host": host_of(F.col(url)), "path": path_of(F.col(url))}, ("host", "path", "rule", "verdict", "key", "action")
    rows = pages.select(*(c for c in pages.columns if c not in taken), *(c.alias(n) for n, c in added.items()))
    urls = saved(rows.select("host", "path").groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("key", key), "urls")
    found = saved(verdicts(urls, rules, **options), "verdicts")
    out = _hot_join(rows.withColumn("key", key), found, "key", _hot_keys(urls, "key"), "left")
    return out.select(*rows.columns, "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
