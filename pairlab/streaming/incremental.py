"""Incremental jobs: process only new inputs, remember what was done.

The reference keeps a set of processed page names / completed article ids
in JSON files and skips them on restart.  Here:

* ``incremental_ingest`` is a Structured Streaming query over a file
  source: the checkpoint records which files were read and a keyed state
  which keys were emitted, so a re-run (or a restart after executor loss) adds
  nothing twice.  ``watermark`` bounds the state when an event-time column exists.
* ``incremental_generate`` computes pending keys with an anti-join against
  the output already written, so re-running is idempotent.  The streaming
  variant does the same inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pairlab.operators.corpus import resume_anti_join
from pairlab.operators.generate import GeneratorFactory, generate_batch
from pairlab.operators.key_filter import KeyFilter
from pairlab.session import cut_lineage


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstPosition(StatefulProcessor):
    """Keeps of each key the row with the lowest position of the batch in which the key comes first.

    The state of a key is one small record, the position kept.
    """

    def __init__(self, order: str, kind: str):
        self.order, self.kind = order, kind

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", f"position {self.kind}, known boolean")

    def handleInputRows(self, key, rows, timerValues):
        if self.kept.exists():
            return
        first = None
        for row in rows:
            if first is None or _place(row, self.order) < _place(first, self.order):
                first = row
        self.kept.update((first[self.order], True))
        yield first

    def close(self) -> None:
        pass


def _place(row: Row, order: str) -> tuple:
    """Nulls come first; ties go to the lesser row as text, so that a replayed batch keeps the same one."""
    return row[order] is not None, row[order] if row[order] is not None else 0, str(row)


def incremental_ingest(spark: SparkSession, source: str, schema: str, key: str, checkpoint: str, out: str,
                       fmt: str = "parquet", watermark: tuple[str, str] | None = None,
                       available_now: bool = True, order: str | None = None) -> StreamingQuery:
    """Stream new files from ``source`` into ``out`` keeping the first row per ``key``.

    With ``order`` the first row is the one with the lowest value of that column
    in the micro-batch in which the key comes first.  A key that an earlier batch
    brought adds nothing, be its position later or lower: what is written stays.  The state
    is keyed (``transformWithState``, RocksDB): one position a key, spread over
    the state store partitions, so no batch reads the output; the file sink's log
    makes a replayed batch add nothing.  Null keys are one key.

    Without ``order`` any row of a batch may be the kept one.  A watermark bounds the
    de-duplication state; without it every key ever seen is kept
    (the reference's processed-page set).
    """
    s = spark.readStream.schema(schema).format(fmt).load(source)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if order:
        kind = s.schema[order].dataType.simpleString()
        s = s.groupBy(key).transformWithState(FirstPosition(order, kind), s.schema, "Append", "None")
    elif watermark:
        s = s.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    else:
        s = s.dropDuplicates([key])
    w = (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    if not order:
        return w.start()
    spark.conf.set(provider, ROCKSDB)  # the query keeps the setting it starts with
    try:
        return w.start()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def _existing(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What is written already; any failure but a missing folder is raised."""
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(out)
    return spark.createDataFrame([], schema)


def incremental_generate(spark: SparkSession, todo: DataFrame, keys: Sequence[str], make_generator: GeneratorFactory,
                         out: str, prompt: str = "prompt", on_error: str = "skip") -> int:
    """Generate for keys not yet in ``out`` and append them; returns the
    number of rows appended (0 on a complete re-run, null keys included).

    A filter of the finished keys is kept next to the output (``KeyFilter``), so that
    only keys that may be finished meet the output, and it isn't shuffled whole.
    """
    keys = list(keys)
    schema = ", ".join(f"`{k}` {todo.schema[k].dataType.simpleString()}" for k in keys) + ", generated string"
    done = _existing(spark, out, schema)
    held = KeyFilter(spark, out, tuple(keys))
    pending = resume_anti_join(todo, done, keys, held.pages(done))
    gen = generate_batch(pending.select(*keys, prompt), make_generator, prompt, "generated", on_error)
    # the model runs once, into the shared checkpoint folder
    gen = cut_lineage(gen.select(*keys, "generated"))
    n = gen.count()
    if n:
        held.merge(gen, n)
        gen.write.mode("append").parquet(out)
    return n


def incremental_generate_stream(stream: DataFrame, keys: Sequence[str], make_generator: GeneratorFactory,
                                out: str, checkpoint: str, prompt: str = "prompt",
                                on_error: str = "skip") -> StreamingQuery:
    """Streaming variant: each micro-batch is anti-joined with ``out`` before
    generation, so replayed batches never duplicate rows."""
    keys = list(keys)

    def run(batch: DataFrame, epoch: int) -> None:
        incremental_generate(batch.sparkSession, batch, keys, make_generator, out, prompt, on_error)

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
