from __future__ import annotations

import json

from tessera.__main__ import main
from tessera.streaming import score as stream


def test_commands(spark, tmp_path):
    rows = [{"vector": [((i * 37 + d * 11) % 100) / 100 for d in range(14)], "label": "fraud" if i % 4 == 0 else "legit"} for i in range(60)]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    main(["generate", "20", f"file://{tmp_path}/bodies"])
    main(["convert", f"file://{tmp_path}/r.json", f"file://{tmp_path}/plain", "--clusters", "0"])
    main(["convert", f"file://{tmp_path}/r.json", f"file://{tmp_path}/clustered", "--clusters", "4"])
    results = []
    for name, source, kind in (("flat", "r.json", "flat"), ("ivf", "r.json", "ivf"), ("cells", "r.json", "cells"), ("levels", "plain", "levels"), ("known", "clustered", "ivf")):
        more = [] if source == "r.json" else ["--binary"]
        main(["build-index", f"file://{tmp_path}/{source}", f"file://{tmp_path}/{name}", "--kind", kind, "--clusters", "4", *more])
        main(["score", f"file://{tmp_path}/bodies", f"file://{tmp_path}/out-{name}", "--index", f"file://{tmp_path}/{name}"])
        results.append(sorted(map(str, spark.read.parquet(f"file://{tmp_path}/out-{name}").collect())))
    # ties go by the rows' numbers, which binary files give anew for each cluster: decisions that no tie settles are the same
    assert results[0] == results[1] == results[2] == results[3] and len(results[0]) == len(results[4]) == 20


def test_refused_bodies_in_a_stream(spark):
    from tessera.plans.scorers import Stub

    bodies = spark.createDataFrame([("{}",), ("nonsense",)], "body string")
    assert sorted(x.error for x in stream.score_batch(bodies, Stub()).collect()) == ["bad_json", "missing_id"]
