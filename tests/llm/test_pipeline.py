"""The stages in their order, each on what the one before it kept."""

from __future__ import annotations

import pathlib
import random

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.common import shared_dir, stored

from .helpers import EDGE, docs
from .test_corpus import changed, sentence


def test_stages(spark, tmp_path):
    r = random.Random(51)
    item = sentence(r, 30)
    line = sentence(r, 30)
    clean = [(i, sentence(r, 120)) for i in range(30)]
    rows = clean + [(100, f"you stupid idiot {sentence(r, 30)}\nyou moron"), (101, changed(r, clean[0][1], 1)), (102, clean[1][1]), (103, f"{sentence(r, 60)} {item}"), (104, f"{sentence(r, 60)}\n{line}"), (105, f"{sentence(r, 60)}\n{line}")]
    rows += [(200 + i, t) for i, t in enumerate(EDGE)] + [(None, sentence(r, 50)), (3, clean[3][1])]
    sf = f"file://{tmp_path}"
    table = docs(spark, rows)
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(100, 1, 1), (0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontaminate", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf), name)
        kept[name] = {x.doc_id: x for x in now.collect()}
        if name != "byte_bpe":
            assert now.columns == table.columns
    ids = {n: set(k) for n, k in kept.items()}
    assert {x for x, _ in rows} - ids["toxicity"] == {100}
    # documents whose lines all stand in others go; those that were empty before stay
    assert ids["toxicity"] - ids["line_dedup"] == {101, 102}
    texts = kept["line_dedup"]
    assert texts[104].text.endswith(line) and line not in texts[105].text and texts[105].n_chars == len(texts[105].text)
    assert ids["minhash_dedup"] - ids["decontaminate"] == {103}
    assert all(kept["byte_bpe"][i].text == t and kept["byte_bpe"][i].exact for i, t in clean)
    assert None in ids["byte_bpe"]
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, ran.collect())) == sorted(map(str, now.collect()))


def test_stages_leave_only_what_the_last_one_reads(spark, tmp_path):
    """Tables of earlier stages and of their steps are gone when the pipeline returns, and its rows can still be read."""
    r = random.Random(52)
    sf = f"file://{tmp_path}"
    docs(spark, [(i, f"{sentence(r, 60)}\n{sentence(r, 20)}") for i in range(20)]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, sentence(r, 30))], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "tessera"
    before = {x.name for x in folder.iterdir()} if folder.exists() else set()
    ran = corpus_pipeline.run(spark, sf)
    left = {x.name.rsplit("-", 1)[0] for x in folder.iterdir() if x.name not in before}
    assert not left & {"toxicity", "line_dedup", "minhash_dedup", "gone", "lines", "pairs", "links", "buckets"} and "decontaminate" in left
    assert ran.count() == 20


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
