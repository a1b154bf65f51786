"""What a worker holds at once doesn't follow the size of Spark's batches; the rows do."""

import tracemalloc

import pyarrow as pa
import pytest

from folioflow.llm import near_dedup, quality


@pytest.mark.parametrize(("work", "key"), [(quality._features, "key"), (near_dedup._sketched, "text_key")])
def test_a_batch_never_stands_whole_as_strings(work, key):
    n = 4000
    text = pa.array([None if k == 7 and key == "text_key" else " ".join([f"{k % 50}{'x' * 400}"] * 20) for k in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, n)], pa.int64()), pa.array(range(n), pa.int64()), text], ["doc_id", key, "text"])
    assert batch.nbytes > 30e6
    rows, first = 0, []
    tracemalloc.start()
    for out in work(iter([batch, batch.slice(0, 0), batch.slice(n - 1)])):
        first = first or out.slice(0, 8).to_pylist()
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n + 1 and peak < batch.nbytes / 3
    assert [r["doc_id"] for r in first] == [None, *range(1, 8)] and [r[key] for r in first] == list(range(8))
    if key == "text_key":
        assert [r["n_shingles"] for r in first] == [1] * 7 + [0] and first[7]["regs"] is None
