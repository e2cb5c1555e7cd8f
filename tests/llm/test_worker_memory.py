"""What a Python worker still holds when a task has gone through its batches."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import common


def test_lean_task_gives_back_after_every_batch(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))

    def doubled(batches):
        for batch in batches:
            said.append(batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([2 * x for x in batch.column(0).to_pylist()])], names=["x"])
        yield pa.RecordBatch.from_arrays([pa.array([-1])], names=["x"])

    rows = [pa.RecordBatch.from_arrays([pa.array(list(range(n)))], names=["x"]) for n in (3, 1, 2)]
    out = [x for b in common.lean(doubled)(iter(rows)) for x in b.column(0).to_pylist()]
    assert out == [0, 2, 4, 0, 0, 2, -1]
    assert said == [3, "back", 1, "back", 2, "back", "back"]
    assert list(common.lean(doubled)(iter([])))[0].column(0).to_pylist() == [-1]


def test_give_back_returns_freed_memory():
    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) // 1024 for line in f if line.startswith("Pss_Anon"))

    common.give_back()
    before = held()
    pool = pa.system_memory_pool()
    blocks = [pa.array([1] * (1 << 13), type=pa.int64(), memory_pool=pool) for _ in range(1600)]
    assert held() - before >= 100
    kept = blocks[::50]  # so that it is not only the heap's end that shrinks
    del blocks
    common.give_back()
    assert held() - before < 50 and len(kept) == 32


def test_stages_send_batches_of_few_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 4000)").alias("text"))
        clean = corpus_pipeline.personal_data(spark, docs, "")
        found = [r.n for r in clean.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(found) >= 3000 * 4000 and max(found) < corpus_pipeline.BATCH_BYTES + 10_000
