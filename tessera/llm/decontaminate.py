"""Benchmark decontamination by winnowing, in DataFrame operations only.

A document word is hit if it lies in an occurrence of a window of a benchmark item: any 13 consecutive words of it, or
the whole item if it has fewer. From each text the k-grams' hashes are winnowed: of every `span` consecutive hashes the
least is kept. Two texts that share k + span - 1 words share such a least hash, so with k = 5 and span = 9 every shared
run of 13 words is found. Items of fewer words get their whole length as k, with a span of 1. Fingerprints of documents
and items are joined; every hit is extended: the windows that hold a matching k-gram are compared word by word with the
benchmark's windows.

Texts are lower-cased in A-Z; words are runs of digits, a-z and characters outside ASCII.

The benchmark's side of a join is broadcast only if its counted bytes are at most BROADCAST_BYTES; else it is shuffled.

Defined cases: null and empty texts have no words and are not contaminated; null and wordless items match nothing; null
item ids are ignored; each row of a repeated id is judged by its own text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored

WINDOW, GRAM = 13, 5
#: Counted bytes up to which a table of the benchmark is broadcast.
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """The hash of every k consecutive words."""
    last = F.size(words) - k
    some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(last >= 0, some).otherwise(F.array().cast("array<bigint>"))


def winnowed(words: Column, k: int, span: int) -> Column:
    """The different least hashes of every `span` consecutive k-grams; fewer k-grams than that give nothing."""
    if span == 1:
        return F.array_distinct(grams(words, k))

    def least(h: Column) -> Column:
        last = F.size(h) - span
        some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda s: F.least(*[F.get(h, s + j) for j in range(span)]))
        return F.when(last >= 0, F.array_distinct(some)).otherwise(F.array().cast("array<bigint>"))

    return bound(grams(words, k), least)


def _classes(lengths: list[int], window: int, gram: int) -> list[tuple[int, int, int]]:
    """(window length, k, span) for each length of windows that the items have."""
    return [(n, n, 1) if n < window else (n, gram, window - gram + 1) for n in lengths]


def _tagged(words: Column, classes: list[tuple[int, int, int]]) -> Column:
    """All fingerprints of a text, as structs of window length and hash."""

    def tagged(n: int, k: int, span: int) -> Column:
        return F.transform(winnowed(words, k, span), lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))

    return F.concat(*[tagged(*c) for c in classes])


def _windows(words: Column, hits: Column, classes: list[tuple[int, int, int]]) -> Column:
    """The windows, as (start, length, words), that hold a k-gram whose hash is a hit of their class."""

    def of(n: int, k: int) -> Column:
        mine = F.transform(F.filter(hits, lambda x: x["n"] == n), lambda x: x["h"])

        def starts(h: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))), lambda i: F.array_contains(mine, F.get(h, i)))
            spread = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (n - k), F.lit(0)), F.greatest(F.least(i, F.size(words) - n), F.greatest(i - (n - k), F.lit(0))))))
            return F.filter(F.array_distinct(spread), lambda s: s + n <= F.size(words))

        some = F.transform(bound(grams(words, k), starts), lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.array_join(F.slice(words, s + 1, n), " ").alias("w")))
        return F.when(F.size(mine) > 0, some)

    empty = F.array().cast("array<struct<s:int,n:int,w:string>>")
    return F.concat(*[F.coalesce(of(n, k), empty) for n, k, _ in classes])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, carry: bool = False) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated.

    With carry, the rows have all columns of docs, and only those that are not contaminated are returned.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = stored(items.withColumn("n", F.least(F.size("words"), F.lit(window))), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most `window` numbers
    classes = _classes(lengths, window, gram)
    whole = F.struct(*map(column, docs.columns)) if carry else F.struct(column(id_col).alias("id"))
    hold = docs.select(whole.alias("doc"), column(text_col).alias("text"), F.xxhash64(column(id_col), column(text_col)).alias("k"))
    if not classes:
        out = hold.select("doc", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_hit"))
        return _finish(out, id_col, carry)

    prints = items.select(F.explode(F.concat(*[F.when(F.col("n") == n, _tagged(F.col("words"), [(n, k, span)])).otherwise(F.array().cast("array<struct<n:int,h:bigint>>")) for n, k, span in classes])).alias("p")).select("p.n", "p.h").distinct()
    prints = stored(prints, "prints")
    wins = stored(items.select("item", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda s: F.array_join(F.slice("words", s + 1, F.col("n")), " "))).alias("w")).distinct(), "windows")

    def near(df: DataFrame) -> DataFrame:
        texts = [F.octet_length(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
        size = df.agg(F.sum(sum(texts, F.lit(64))).alias("n")).first()["n"] or 0
        return F.broadcast(df) if size <= broadcast_bytes else df


    # the id is in the key, so that copies of a text are dealt over many tasks
    found = docs.select(F.xxhash64(column(id_col), column(text_col)).alias("k"), column(text_col).alias("text")).select("k", F.explode(bound(words_of(F.col("text")), lambda w: _tagged(w, classes))).alias("p"))
    hits = found.select("k", "p.n", "p.h").join(near(prints), ["n", "h"]).groupBy("k").agg(F.collect_set(F.struct("n", "h")).alias("hits"))
    # the small side is hashed, so that the texts needn't be sorted
    joined = hold.join(hits.hint("shuffle_hash"), "k", "left")
    told = bound(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.when(F.col("hits").isNotNull(), _windows(w, F.col("hits"), classes)).alias("wins")))
    rows = stored(joined.select("doc", told.alias("t")).select("doc", "t.*", F.monotonically_increasing_id().alias("row")), "extended")
    spots = rows.where("wins is not null").select("row", F.explode("wins").alias("x")).select("row", "x.s", "x.n", "x.w").join(near(wins), ["n", "w"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("s", "n")), lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    judged = spots.groupBy("row").agg(covered.cast("bigint").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.drop("wins").join(judged.hint("shuffle_hash"), "row", "left")
    return _finish(out, id_col, carry)


def _finish(rows: DataFrame, id_col: str, carry: bool) -> DataFrame:
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    bad = (n_hit > 0) & (20 * n_hit >= F.col("n_words"))
    if carry:
        return rows.where(~bad).select("doc.*")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(F.col("doc.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), bad.alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return contamination(docs, benchmark, carry=True, **more)
