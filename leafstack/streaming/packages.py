"""A stream of packages: files are parsed as they arrive, and each micro-batch runs through the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafstack.common import Scratch
from leafstack.config import ParserConfig
from leafstack.operators import relations
from leafstack.plans import pipeline
from leafstack.sources import reader
from leafstack.sources.package import Options

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_packages(spark: SparkSession, folder: str, options: Options = Options(), per_trigger: int = 1000) -> DataFrame:
    """Streaming frame of parsed packages (see ``reader.PARSED``). Parsing keeps no state, so any trigger works."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(folder)
    return reader.parse_packages(files, options)


def run_pipeline(spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: ParserConfig | None = None, per_trigger: int = 1000, once: bool = False, also: Callable | None = None) -> StreamingQuery:
    """Write Markdown, chunks and relations of arriving packages below ``out``, one folder per batch.

    A batch that runs again after a failure overwrites its own folder, so results aren't doubled. ``also`` gets each
    batch's :class:`~leafstack.plans.pipeline.Parsed` and its number.
    """
    cfg = cfg or ParserConfig()

    def batch(rows: DataFrame, number: int) -> None:
        scratch = Scratch(spark)  # what a batch writes in between goes when its results are stored
        try:
            with scratch:
                frames = reader.frames(rows)
                got = pipeline.parse(frames.pages, frames.elements.drop("extra"), frames.cells, cfg, relations.no_op_verifier())
                for name, df in (("markdown", got.markdown()), ("chunks", got.chunks()), ("relations", got.relations), ("errors", frames.errors)):
                    df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number:08d}")
                if also:
                    also(got, number)
        finally:
            scratch.remove()

    options = Options(cfg.include_master_shapes, cfg.deduplicate_master_shapes)
    writer = stream_packages(spark, folder, options, per_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
