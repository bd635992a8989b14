"""URL filters by host suffixes and path prefixes: hashed expressions, joined on short prefixes of their digests.

A rule (host, path, action) fits the host and all its subdomains, if the url's path starts with the rule's. Every rule has
a key: the end of its host and the start of its path, up to some number of labels and of slashes or characters. These
numbers are the shapes that the rules have; each url is expanded into its expressions of these shapes, the short prefixes
of the expressions' digests are joined with those of the rules, and what meets is confirmed by the digest of the whole
rule. Of the rules that fit, the longest wins, of equally long ones that with the longer host, and block wins over allow.
A url that no rule fits gets the default verdict.

Urls are counted first, so that each different one is expanded once, however many rows have it. Rules are broadcast only
up to a counted size; beyond it, expressions that are frequent (com/ may be one of a third of all urls) stay where they
are and meet a broadcast of the few rules of their keys.

Defined cases: the host lies between the first :// and the next /, ? or #, with A-Z in lower case, and keeps its port and
user; a null url, or one without ://, has an empty host and path, which no rule fits but one with an empty host; rules
with a null host or action and rules whose path is neither empty nor starts with / fit nothing; a null path of a rule is
empty; columns of pages named host, path, rule or verdict give way; without rules every row gets the default; an empty
table gives an empty one; each row is judged, also where ids repeat or are null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored
from .skew import heavy, skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest on which expressions and rules are joined.
SHORT = 8
#: Keys are cut to so many dots, slashes and characters, which bounds the number of shapes; what is cut off is confirmed.
DOTS, SLASHES, CHARS, COARSE, LONGEST = 16, 32, 256, 64, 4096
#: Counted bytes of rules up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
MADE = ("host", "path", "rule", "verdict")
RULES = "host string, path string, action string"


def rules(spark: SparkSession, told: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) from a list; action is allow or block."""
    return spark.createDataFrame(told, RULES)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _suffix(host: Column, dots: Column) -> Column:
    """The last labels of host, with so many dots between them; host has as many at least."""
    return F.call_function("substring_index", host, F.lit("."), -(dots + 1))


def _prepared(told: DataFrame) -> DataFrame:
    """Rules with their shape (d dots; s slashes, or -1 and c characters), the short prefix of their key's digest, and the
    digest, dots and length that confirm them."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    clean = told.select(host.alias("host"), path.alias("path"), (F.col("action") == "block").alias("block"))
    clean = clean.where("host is not null and block is not null and (path = '' or startswith(path, '/'))").groupBy("host", "path").agg(F.max("block").alias("block"))
    dots, slashes, chars = _count(F.col("host"), "."), _count(F.col("path"), "/"), F.length("path")
    by_slash = ((chars == 0) | F.endswith("path", F.lit("/"))) & (slashes <= SLASHES)
    cut = F.when(chars <= CHARS, chars).otherwise(F.least(F.floor(chars / COARSE).cast("int") * COARSE, F.lit(LONGEST)))
    shaped = clean.withColumns({
        "dots": dots, "chars": chars, "d": F.least(dots, F.lit(DOTS)), "s": F.when(by_slash, slashes).otherwise(-1), "c": F.when(by_slash, -1).otherwise(cut),
        "rule": F.concat("host", "path"), "digest": F.sha2(F.concat("host", "path"), 256),
    })
    key = F.concat(_suffix(F.col("host"), F.col("d")), F.when(F.col("s") >= 0, F.col("path")).otherwise(F.call_function("left", F.col("path"), F.col("c"))))
    return shaped.select("d", "s", "c", F.substring(F.sha2(key, 256), 1, SHORT).alias("short"), "digest", "dots", "chars", "rule", F.length("host").alias("n_host"), "block")


def _expressions(urls: DataFrame, shapes: list) -> DataFrame:
    """(id, host, path, short) of every url and every shape that it is long enough for."""
    listed = F.from_json(F.lit(json.dumps([{"d": r["d"], "s": r["s"], "c": r["c"]} for r in shapes])), "array<struct<d:int,s:int,c:int>>")
    counted = urls.withColumns({"n_dots": _count(F.col("host"), "."), "n_slashes": _count(F.col("path"), "/"), "n_chars": F.length("path")})
    fits = F.filter(listed, lambda x: (x["d"] <= F.col("n_dots")) & (x["s"] <= F.col("n_slashes")) & (x["c"] <= F.col("n_chars")))
    each = counted.select("id", "host", "path", F.explode(fits).alias("x"))
    x = F.col("x")
    # as many slashes as wanted, and what is before them; none: the empty prefix
    upto = F.when(x["s"] == 0, "").otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), x["s"]), F.lit("/")))
    start = F.when(x["s"] >= 0, upto).otherwise(F.call_function("left", F.col("path"), x["c"]))
    return each.select("id", "host", "path", F.substring(F.sha2(F.concat(_suffix(F.col("host"), x["d"]), start), 256), 1, SHORT).alias("short"))


def _found(urls: DataFrame, told: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(id, rule, block): the rule that wins for each url (id, host, path) that one fits."""
    ready = stored(_prepared(told), "url-rules")
    shapes = ready.select("d", "s", "c").distinct().orderBy("d", "s", "c").collect()  # bounded by DOTS, SLASHES, CHARS, COARSE and LONGEST
    size = ready.agg(F.coalesce(F.sum(F.octet_length("rule") + 150), F.lit(0))).first()[0]
    made, ready = _expressions(urls, shapes), ready.drop("d", "s", "c")
    if size <= broadcast_bytes:
        met = made.join(F.broadcast(ready), "short")
    else:
        made = stored(made, "url-expressions")
        counted = made.groupBy("short").agg(F.count("*").alias("n"))
        hot = heavy(counted, "short", "n", made.count())
        # a key of a frequent expression has few rules, unless thousands share its LONGEST characters: then it is joined plainly
        held = ready.where(F.col("short").isin(hot)).agg(F.coalesce(F.sum(F.octet_length("rule") + 150), F.lit(0))).first()[0]
        met = skew_join(made, ready, "short", hot if held <= BROADCAST_BYTES else [])
    whole = F.concat(_suffix(F.col("host"), F.col("dots")), F.call_function("left", F.col("path"), F.col("chars")))
    sure = met.where((_count(F.col("host"), ".") >= F.col("dots")) & (F.sha2(whole, 256) == F.col("digest")))
    best = sure.groupBy("id").agg(F.max(F.struct(F.length("rule").alias("n"), "n_host", "block", "rule")).alias("best"))
    return best.select("id", F.col("best.rule").alias("rule"), F.col("best.block").alias("block"))


def _judged(pages: DataFrame, told: DataFrame, url_col: str, default: str, broadcast_bytes: int) -> tuple[DataFrame, Column]:
    """pages with __rule, and the verdict as a column of it."""
    if default not in ("allow", "block"):
        raise ValueError("the default verdict is allow or block")
    host, path = host_of(column(url_col)), path_of(column(url_col))
    rows = pages.withColumn("__url", F.sha2(F.concat(host, path), 256))
    counted = stored(rows.groupBy("__url").agg(F.first(host).alias("host"), F.first(path).alias("path"), F.count("*").alias("n")), "urls")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = _found(counted.select(F.col("__url").alias("id"), "host", "path"), told, broadcast_bytes)
    found = found.select(F.col("id").alias("__url"), F.col("rule").alias("__rule"), F.col("block").alias("__block"))
    met = skew_join(rows, found, "__url", heavy(counted, "__url", "n", total), "left")
    return met, F.when(F.col("__block").isNull(), default).when(F.col("__block"), "block").otherwise("allow")


def judge(pages: DataFrame, told: DataFrame, url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with host, path, rule (host and path of the one that wins, or null) and verdict (allow or block)."""
    met, verdict = _judged(pages, told, url_col, default, broadcast_bytes)
    own = [column(c) for c in pages.columns if c not in MADE]
    return met.select(*own, host_of(column(url_col)).alias("host"), path_of(column(url_col)).alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"))


def allowed(pages: DataFrame, told: DataFrame, url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of pages whose url is not blocked, as they are."""
    met, verdict = _judged(pages, told, url_col, default, broadcast_bytes)
    return met.where(verdict == "allow").select(*[column(c) for c in pages.columns])
