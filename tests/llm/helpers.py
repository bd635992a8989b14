"""Small tables, with the cases that operators have to bear."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_tokens string, id string, k string, block int, doc string"


def docs(spark, rows):
    """Documents of (id, text), with columns whose names operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", "y", None, 7, "d") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


EDGE = [None, "", " ", "\n\n", "a", "'s", "<|endoftext|>", "é日本語  x", "x" * 30_000, "ab " * 9_000, "\r\n\t  tab", "ßẞ İ", "😀 emoji 😀"]
