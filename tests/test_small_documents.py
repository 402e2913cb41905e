"""Documents in many small files share tasks."""

import json

from trackloom.sources import documents


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k}.json").write_text(json.dumps({"a": [k, [k, "]"]], "b": [{"c": k}]}))
    own = documents.Documents(spark, f"file://{tmp_path}")
    assert own.count <= 2 * spark.sparkContext.defaultParallelism < 60
    got = sorted((x["value"] for x in own.items("a").collect()))
    assert got == sorted(v for k in range(60) for v in (str(k), f'[{k}, "]"]'))
    assert sorted(x["value"] for x in own.items("b").collect()) == sorted(f'{{"c": {k}}}' for k in range(60))
