"""K5: a frame of many objects is written in their order without a search for each."""

import json

from trackloom.sources import writers


def test_a_frame_of_many_objects(spark):
    rows = spark.range(3000).selectExpr(
        "1 as frame", "2999 - id as global_id", "if(id = 5, null, 'Person') as class_name", "cast(id as double) as x", "0.0D as y", "0.0D as z", "0.5D as w", "0.6D as l", "1.7D as h", "0.1D as yaw",
        "explode(if(id % 2 = 1, array('c0', 'c1'), array('c0'))) as camera", "struct(1.0D as x1, 2.0D as y1, 3.0D as x2, 4.0D as y2) as box",
    )
    found = writers.frame_document(rows)
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
    objects = json.loads(found.first()["objects"])
    assert [o["object id"] for o in objects] == list(range(3000))
    assert objects[0] == {"object type": "Person", "object id": 0, "3d location": [2999.0, 0.0, 0.0], "3d bounding box scale": [0.5, 0.6, 1.7], "3d bounding box rotation": [0.0, 0.0, 0.1], "2d bounding box visible": {"c0": [1.0, 2.0, 3.0, 4.0], "c1": [1.0, 2.0, 3.0, 4.0]}}
    assert "object type" not in objects[2994]
