"""The stateful processor over a file stream, against the grouped fold."""

from pyspark.sql import functions as F

from cairnfold.functions.fold_state import Slot
from cairnfold.limits import Limits
from cairnfold.operators import fold, normalize
from cairnfold.plans.analysis import assemble, deliveries
from cairnfold.streaming.fold_stream import Kept, _slot_of, _slot_row, fold_stream

from .test_codec import HEADER, STREAM, schedule
from .test_trace import decided, dup, env, move, records


def told(spark, tmp_path, name, rows, parts, limits=Limits()):
    """Dispositions of rows that come in micro-batches, with an end marker behind them, and those of the batch fold."""
    trace, _ = assemble(records(spark, *rows), decided(spark))
    all_ = deliveries(trace).where("mode = 'faulted'").join(trace.streams.select("trace", "stream_idx", "initial_cursor", "trusted"), ["trace", "stream_idx"]).persist()
    where = str(tmp_path / name)
    for part in parts:
        all_.where(part).coalesce(1).write.mode("append").parquet(where)
    end = all_.limit(1).withColumn("delivery_pos", F.lit(99).cast("bigint")).withColumn("source_idx", F.lit(None).cast("bigint"))
    end.coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(where)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = fold_stream(stream, limits).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.delivery_pos, r.disposition) for r in spark.table(name).orderBy("delivery_pos").collect()]
    visible = fold.visible_streams(trace.schedules, trace.streams, ("faulted",))
    batch = [(r.delivery_pos, r.disposition) for r in fold.dispositions(visible, deliveries(trace), limits).orderBy("delivery_pos").collect()]
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return trace, got, batch, left


def test_stream_equals_batch(spark, tmp_path):
    rows = [HEADER, STREAM, *(env(f"e{i}", i, str(i)) for i in range(6)), schedule(dup("e1", 2), move("e5", "e0"), move("e3", "e2"))]
    trace, got, batch, left = told(spark, tmp_path, "plain", rows, ("delivery_pos < 3", "delivery_pos >= 3"))
    assert got == [*batch, (99, "finished")] and left == 0
    assert normalize.lookup(trace.envelopes, "source_idx", 2).first().envelope_id == "e2"


def test_a_failed_stream_ends_in_an_error(spark, tmp_path):
    """After a failure nothing is admitted, in whatever batch; the end is an error, and no state is left."""
    rows = [HEADER, STREAM, *(env(f"e{i}", i, str(i)) for i in range(6)), schedule(dup("e1", 2))]
    _, got, batch, left = told(spark, tmp_path, "failing", rows, ("delivery_pos < 2", "delivery_pos = 2", "delivery_pos in (3, 4, 5)", "delivery_pos > 5"), Limits(max_cache_keys_per_stream=3))
    assert got == [*batch, (99, "error:state_failed")] and batch[-1][1] == "error:state_resource_limit" and left == 0


class Fake:
    """A map state in memory that counts what is asked of it."""

    def __init__(self):
        self.rows, self.writes, self.reads = {}, 0, 0

    def containsKey(self, k):
        self.reads += 1
        return k in self.rows

    def getValue(self, k):
        return self.rows[k]

    def updateValue(self, k, v):
        self.writes += 1
        self.rows[k] = v

    def removeKey(self, k):
        self.writes += 1
        del self.rows[k]

    def keys(self):
        return iter(list(self.rows))

    def clear(self):
        self.rows.clear()


def test_a_batch_touches_what_its_deliveries_touch():
    state = Fake()
    for start in range(0, 10_000, 1000):
        kept = Kept(state, start, lambda v: (v,), lambda _, r: r[0])
        for i in range(start, start + 1000):
            kept[str(i)] = i
        kept.flush()
    state.writes = state.reads = 0
    kept = Kept(state, 10_000, lambda v: (v,), lambda _, r: r[0])
    assert kept["7"] == 7 and "nine" not in kept and len(kept) == 10_000
    del kept["8"]
    kept["new"] = 1
    assert kept.flush() == 4 and state.writes == 3 and state.reads < 10 and len(state.rows) == 10_000
    assert sorted(Kept(state, 10_000, None, lambda _, r: r[0])) == sorted([*(str(i) for i in range(10_000) if i != 8), "new"])
    kept.clear()
    kept["a"] = 2
    kept.flush()
    assert state.rows == {("a",): (2,)}
    slots = Kept(Fake(), 0, _slot_row, _slot_of, int)
    slots[5] = Slot([b"p", b"q"])
    slots.flush()
    again = Kept(slots.state, 1, _slot_row, _slot_of, int)
    assert list(again) == [5] and again[5].prints == [b"p", b"q"] and again[5].delivery is None
