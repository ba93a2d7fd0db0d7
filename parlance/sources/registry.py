"""The dataset registry: names to places, formats, columns and tags."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import align, split, validate
from parlance.sources.scan import read_any

CONFIG = "dataset_info.json"
_COMMON = ("system", "tools", "images", "videos", "audios", "chosen", "rejected", "kto_tag")
_OWN = {"alpaca": ("prompt", "query", "response", "history"), "sharegpt": ("messages",)}


@dataclass
class Dataset:
    """An entry: where it is read from ("file", "script" or "hub") and how its columns are named."""

    name: str
    load_from: str
    place: str
    formatting: str = "alpaca"
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None
    columns: align.Columns = field(default_factory=align.Columns)


def resolve(name: str, info: dict) -> Dataset:
    """An entry of the registry.

    A hub comes before a script and a script before a file.  Where columns are
    listed, those that aren't are unset: their defaults don't hold any more; the
    same is true of tags.
    """
    if name not in info:
        raise ValueError(f"undefined dataset {name}")
    entry = info[name]
    hub = next((entry[k] for k in ("hf_hub_url", "ms_hub_url", "om_hub_url") if k in entry), None)
    place = hub or entry.get("script_url") or entry["file_name"]
    source = "hub" if hub else "script" if "script_url" in entry else "file"
    formatting = entry.get("formatting", "alpaca")
    columns = align.Columns(ranking=entry.get("ranking", False))
    if "columns" in entry:
        for c in (*_COMMON, *_OWN[formatting]):
            setattr(columns, c, entry["columns"].get(c))
    if formatting == "sharegpt" and "tags" in entry:
        given = entry["tags"]
        columns.tags = align.Tags(*[given.get(f"{k}_tag") for k in ("role", "content", "user", "assistant", "observation", "function", "system")])
    return Dataset(name, source, place, formatting, entry.get("subset"), entry.get("split", "train"), entry.get("folder"), entry.get("num_samples"), columns)


def load_info(spark: SparkSession, folder: str) -> dict:
    """The registry file of a folder, in any file system that Spark reads."""
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/{CONFIG}", wholetext=True).collect()))


def scan(spark: SparkSession, dataset: Dataset, folder: str, max_samples: int | None = None, seed: int = 42) -> DataFrame:
    """The rows of a dataset: as many as its entry wants, then cut to max_samples, by a hash of the row."""
    if dataset.load_from != "file":
        raise NotImplementedError(f"{dataset.load_from} datasets need a network; write them to files first")
    rows = read_any(spark, f"{folder}/{dataset.place}")
    if dataset.num_samples is None and max_samples is None:
        return rows
    keyed = rows.withColumn("__key", F.md5(F.to_json(F.struct(*rows.columns))))
    keyed = split.sample_n(keyed, "__key", dataset.num_samples, seed) if dataset.num_samples is not None else keyed.withColumn("draw", F.lit(0))
    if max_samples is not None:
        keyed = split.head(keyed, "__key", max_samples)
    return keyed.drop("__key", "draw")


def aligned(spark: SparkSession, names: list[str], folder: str, stage: str, max_samples: int | None = None) -> DataFrame:
    """All named datasets in the aligned schema, those rows that the stage can use, with their dataset's name."""
    info, out = load_info(spark, folder), []
    for name in names:
        dataset = resolve(name, info)
        align.check_stage(stage, dataset.columns.ranking)
        rows = scan(spark, dataset, folder, max_samples)
        convert = align.from_messages if dataset.formatting == "sharegpt" else align.from_instructions
        out.append(align.well_formed(convert(rows, dataset.columns), stage).withColumn("dataset", F.lit(name)))
    return split.concatenated(out)


check = validate.DataArguments
