"""URL filtering: rules by host and path, then a list of canonical URLs through a blocked Bloom filter and an exact join.

The filter is a table with a row for each block of 256 bits, so its size follows the list and Spark picks the join by it; a URL's
bits are all in one block. URLs that miss a bit are not listed; the few others go on to a hash join with the list itself, which
removes the filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

BITS_PER_KEY = 16
LANES = [f"w{i}" for i in range(8)]  # 32 bits each


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without the slash at its end, and the query's parameters in order, without those that only track."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)") & (p != "")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), tail)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, ``host/path``) that fits: its host or a subdomain, and a path that starts with the
    rule's. Null if none does. Rules are settings, so there are few."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(8)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """The filter of a stored table with the column ``key``: a row (``block`` and eight words) for each block that has bits."""
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // 256))
    rows = listed.select(_block(F.col("key"), blocks).alias("block"), *(b.alias(w) for b, w in zip(_bits(F.col("key")), LANES)))
    return stored(rows.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in LANES)), "bloom"), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], *, url_column: str = "url") -> DataFrame:
    """All columns of ``pages`` and the struct ``_judged``: ``host``, ``path``, ``rule`` and ``verdict``.

    A rule decides where one fits; otherwise ``block`` if the canonical form of the URL is that of a URL in ``listed`` (one column,
    ``url``), else ``allow``. Null URLs and those without ``://`` have an empty host and path and are allowed. Repeats are judged alike.
    """
    url = F.col(f"_row.{url_column}")
    keys = stored(listed.filter("url IS NOT NULL").select(canonical(F.col("url")).alias("key")).filter("key <> ''").distinct(), "listed")
    filter_, blocks = bloom(keys)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row")).select(
        "_row", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key")).withColumn(
        "fit", rule_for(F.col("host"), F.col("path"), rules))
    probed = rows.withColumn("block", _block(F.col("key"), blocks)).join(filter_, "block", "left")
    hit = F.lit(True)
    for bit, lane in zip(_bits(F.col("key")), LANES):
        hit = hit & (F.coalesce(F.col(lane), F.lit(0)).bitwiseAND(bit) != 0)
    probed = probed.withColumn("hit", hit & F.col("fit").isNull()).select("_row", "host", "path", "fit", "key", "hit")
    missed = probed.filter("NOT hit").withColumn("found", F.lit(False))
    exact = probed.filter("hit").join(keys.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    method = F.when(F.col("found"), "block").otherwise("allow")
    return missed.unionByName(exact).select("_row.*", F.struct(
        "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict")).alias("_judged"))
