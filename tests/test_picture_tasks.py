"""Pictures are far larger than the pages they are drawn from: a task has few, and sends its answers on as it goes."""

import pyarrow as pa

from lingoscope.functions import pixels
from lingoscope.plans import picture_queries
from lingoscope.sources import snapshots


def test_pages_of_one_file_are_drawn_by_several_tasks(spark):
    assert picture_queries.page_pictures(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 2


def test_answers_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "TOGETHER", 5000)
    sent = []
    monkeypatch.setattr(type(pairs := spark.range(1)), "mapInArrow", lambda self, run, schema: sent.append(run))
    snapshots.overlays(pairs)
    shade = lambda grey: pixels.encode(pixels.np.full((9, 9, 1), grey, pixels.np.uint8))
    rows = [{"run_id": "r", "url": str(i), "picture": shade(i), "baseline": shade(200) if i else None, "viewport": "v", "baseline_viewport": "v", "masks": [], "baseline_masks": []} for i in range(10)]
    parts = list(sent[0](iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(parts) > 1
    got = [r for p in parts for r in p.to_pylist()]
    assert [r["url"] for r in got] == [str(i) for i in range(10)] and got[0]["overlay"] is None and all(r["overlay"] for r in got[1:])
