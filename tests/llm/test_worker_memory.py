"""What tasks hold at once, and what workers keep between tasks."""

import numpy as np
import pyarrow as pa

from lingoscope.llm import common, toxicity


def test_clean_rows_leave_in_small_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "GROUP", 40)
    model = toxicity.Model(toxicity.log_model(np.ones(27**4, np.int64)), {"awful": 9.0}, -1.0)
    texts = ["a fine day", None, "an awful day", "", "words " * 20, "awful", "the end"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(toxicity.clean_parts(batch, 1, toxicity.Reader(model)))
    assert len(parts) > 3 and all(p.num_rows == 1 or common.utf8_of(p.column(1))[1][-1] <= 40 for p in parts if p.num_rows)
    assert [r for p in parts for r in p.to_pylist()] == [r for r in batch.to_pylist() if "awful" not in (r["text"] or "")]


def test_a_task_gives_memory_back_when_it_ends(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    run = common.sparing(lambda batches: (b + 1 for b in batches))
    batches = run(iter([1, 2]))
    assert next(batches) == 2 and not given
    assert list(batches) == [3] and given == [1]
