"""Scans of the file types that datasets come in, and parsers of raw dataset files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from parlance.functions.text import strip
from parlance.operators import parse

#: File extensions and how they are read.
TYPES = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text", "arrow": "arrow"}
_MESSAGE = "the files of a dataset must be of one known type"


def _files(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(hadoop).isFile():
        return [path]
    return [str(x.getPath().toString()) for x in system.listStatus(hadoop) if not x.getPath().getName().startswith(("_", "."))]


def kind_of(files: list[str]) -> str:
    """The type that all files share."""
    kinds = {TYPES.get(f.rsplit(".", 1)[-1].lower()) for f in files}
    if len(kinds) != 1 or None in kinds:
        raise ValueError(f"{_MESSAGE}: {sorted(files)[:3]}")
    return kinds.pop()


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file or a folder of files of one type.  A schema saves the pass that infers it."""
    files = _files(spark, path)
    kind = kind_of(files)
    reader = spark.read.schema(schema) if schema and kind not in ("text", "arrow") else spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind == "json":
        return read_json(spark, path, schema, array=not all(f.lower().endswith(".jsonl") for f in files))
    if kind == "text":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if kind == "arrow":
        return read_arrow(spark, path, schema)
    return reader.parquet(path)


def read_arrow(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Arrow streams, or files of them, where Spark's executors read them; a file is one task's.  Without a schema that of the first file holds."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def opened(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                yield pa.ipc.open_file(raw) if raw.slice(0, 6).to_pybytes() == b"ARROW1" else pa.ipc.open_stream(raw)

    def kind(batches):
        for reader in opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array([reader.schema.serialize().to_pybytes()], pa.binary())], ["schema"])

    def rows(batches):
        for reader in opened(batches):
            yield from reader.read_all().to_batches()

    if schema is None:
        found = files.limit(1).mapInArrow(kind, "schema binary").first()[0]
        schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(found))))
    return files.mapInArrow(rows, schema)


def read_json(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    """JSON lines, or files that are JSON arrays."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", array).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_mcq(spark: SparkSession, path: str) -> DataFrame:
    """Headerless question files."""
    return spark.read.schema("question string, A string, B string, C string, D string, answer string").option("multiLine", True).option("escape", '"').csv(path)


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of transcripts that were chosen and rejected, as history, instruction, chosen, rejected."""
    rows = spark.read.schema("chosen string, rejected string").json(path)
    return rows.select(parse.preference_text(F.col("chosen"), F.col("rejected")).alias("x")).select("x.*")


def read_multiturn(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an instruction with its earlier turns and an output, as conversations."""
    rows = spark.read.schema("instruction string, output string").json(path)
    said = F.concat(parse.human_assistant(F.col("instruction"), "Human:", "Assistant:"), F.array(F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content"))))
    kept = F.filter(said, lambda m: strip(m["content"]) != "")
    return rows.select(F.transform(kept, lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), strip(m["content"]).alias("value"))).alias("conversations"))


def read_alternating(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of id and a list of texts in turn; unreadable lines and lists with fewer than two texts go."""
    rows = spark.read.schema("id string, data array<string>").option("mode", "DROPMALFORMED").json(path)
    return rows.select("id", parse.alternating(F.col("data")).alias("conversations")).where("conversations IS NOT NULL")


def held_out_ids(spark: SparkSession, path: str, name: str = "dialogue_id") -> DataFrame:
    """A JSON array of ids as a column."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias(name))


def prepared(spark: SparkSession, path: str) -> DataFrame:
    """A dataset that was tokenised and written before: no other setting applies to it."""
    return spark.read.parquet(path)
