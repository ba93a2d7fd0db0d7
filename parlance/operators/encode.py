"""Encoding of aligned examples to ids and labels, and padding to batches.

A tokenizer is whatever gives arrays of ids; ``hashed`` stands in for one where
there is none: a number for each word between white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.score import budget
from parlance.functions.text import words
from parlance.schemas import IGNORE

EOS, PAD = 2, 0
NO_IDS = "CAST(array() AS array<int>)"


def hashed(text: Column) -> Column:
    """Ids of words: a positive hash, above the special ids."""
    return F.transform(words(text), lambda w: (F.pmod(F.hash(w), F.lit(50_000)) + 10).cast("int"))


def pair_tokens(rows: DataFrame, pairs: str, tokenizer=hashed) -> DataFrame:
    """rows with turns: (source, target) ids of (user, assistant) texts; a target ends with EOS."""
    turn = lambda p: F.struct(tokenizer(p["user"]).alias("source"), F.concat(tokenizer(p["assistant"]), F.array(F.lit(EOS))).alias("target"))
    return rows.withColumn("turns", F.transform(pairs, turn))


def _cut(ids: Column, n: Column) -> Column:
    return F.slice(ids, F.lit(1), n)


def _ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE), n.cast("int"))


def supervised(rows: DataFrame, cutoff: int, turns: str = "turns", train_on_prompt: bool = False, mask_history: bool = False, efficient_eos: bool = False) -> DataFrame:
    """rows with input_ids, attention_mask and labels of all turns under a cutoff.

    Each turn gets what is left of the cutoff, shared by its two sides.  With
    mask_history the last turn comes first and is the only one with labels.
    """
    seq = F.reverse(F.col(turns)) if mask_history else F.col(turns)
    indexed = F.transform(seq, lambda t, k: F.struct(t["source"].alias("source"), t["target"].alias("target"), k.alias("k")))
    start = F.struct(F.expr(NO_IDS).alias("ids"), F.expr(NO_IDS).alias("labels"), F.lit(1 if efficient_eos else 0).alias("used"))

    def step(acc: Column, t: Column) -> Column:
        left = F.lit(cutoff) - acc["used"]
        b = budget_of(F.size(t["source"]), F.size(t["target"]), left)
        source, target = _cut(t["source"], b["source"]), _cut(t["target"], b["target"])
        s_label = source if train_on_prompt else _ignored(b["source"])
        if efficient_eos and not train_on_prompt:
            s_label = F.when(b["source"] > 0, F.concat(F.array(F.lit(EOS)), _ignored(b["source"] - 1))).otherwise(s_label)
        t_label = F.when(t["k"] != 0, _ignored(b["target"])).otherwise(target) if mask_history else target
        ids, labels = F.concat(source, target), F.concat(s_label, t_label)
        joined = (F.concat(ids, acc["ids"]), F.concat(labels, acc["labels"])) if mask_history else (F.concat(acc["ids"], ids), F.concat(acc["labels"], labels))
        after = F.struct(joined[0].alias("ids"), joined[1].alias("labels"), (acc["used"] + b["source"] + b["target"]).alias("used"))
        return F.when(left > 0, after).otherwise(acc)

    out = rows.withColumn("__x", F.aggregate(indexed, start, step))
    tail = F.array(F.lit(EOS)) if efficient_eos else F.expr(NO_IDS)
    out = out.withColumns({"input_ids": F.concat("__x.ids", tail), "labels": F.concat("__x.labels", tail)}).drop("__x")
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def budget_of(source: Column, target: Column, cutoff: Column) -> Column:
    """budget with a cutoff that is a column."""
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise((cutoff.cast("double") * (target / F.greatest(source + target, F.lit(1)))).cast("int"))
    kept = F.least(most, target)
    return F.struct(F.least(F.greatest(cutoff - kept, F.lit(0)), source).cast("int").alias("source"), kept.cast("int").alias("target"))


def pairwise(rows: DataFrame, prompt: str, chosen: str, rejected: str, cutoff: int) -> DataFrame:
    """Ids and labels of a prompt with its chosen and its rejected answer; the budget is that of the longer one."""
    b = budget(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), cutoff)
    out = rows.withColumn("__b", b).withColumn("__p", _cut(F.col(prompt), F.col("__b.source")))
    for name, column in (("chosen", chosen), ("rejected", rejected)):
        answer = _cut(F.col(column), F.col("__b.target"))
        out = out.withColumns({f"{name}_input_ids": F.concat("__p", answer), f"{name}_labels": F.concat(_ignored(F.size("__p")), answer)})
    return out.drop("__b", "__p")


def feedback(rows: DataFrame, prompt: str, answer: str, kl_answer: str, cutoff: int) -> DataFrame:
    """Ids and labels of a prompt with its answer and with the answer of another row, each with its own budget."""
    out = rows
    for name, column in (("", answer), ("kl_", kl_answer)):
        b = budget(F.size(prompt), F.size(column), cutoff)
        p, a = _cut(F.col(prompt), b["source"]), _cut(F.col(column), b["target"])
        out = out.withColumns({f"{name}input_ids": F.concat(p, a), f"{name}labels": F.concat(_ignored(b["source"]), a)})
    return out


def mismatched(rows: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """rows with kl_ columns of the row at the same place from the end of its batch."""
    from pyspark.sql import Window as W

    group = W.partitionBy(batch)
    placed = rows.withColumn("__k", F.row_number().over(group.orderBy(order))).withColumn("__n", F.count("*").over(group))
    other = placed.select(F.col(batch).alias("__b"), F.col("__k").alias("__o"), *[F.col(c).alias(f"kl_{c}") for c in columns])
    same = (placed[batch] == other["__b"]) & (other["__o"] == placed["__n"] + 1 - placed["__k"])
    return placed.join(other, same).drop("__k", "__n", "__b", "__o")


def unsupervised(rows: DataFrame, prompt: str, answer: str, cutoff: int) -> DataFrame:
    """input_ids of the prompt and labels of the answer, each cut to its budget."""
    b = budget(F.size(prompt), F.size(answer), cutoff)
    return rows.withColumns({"input_ids": _cut(F.col(prompt), b["source"]), "labels": _cut(F.col(answer), b["target"])})


def blocks(rows: DataFrame, batch: str, order: str, ids: str, size: int) -> DataFrame:
    """Blocks of size ids of each batch's rows end to end; what is left at the end of a batch goes.

    A batch is as many rows as its column says, so it is bounded by whoever set it.
    """
    every = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, ids))), lambda x: x[ids]))
    joined = rows.groupBy(batch).agg(every.alias("__ids")).withColumn("__n", F.floor(F.size("__ids") / size).cast("int")).where("__n > 0")
    return joined.select(batch, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda k: F.slice("__ids", k * size + 1, F.lit(size)))).alias("block", "input_ids"))


def truncated(rows: DataFrame, ids: str, size: int) -> DataFrame:
    return rows.withColumn(ids, _cut(F.col(ids), F.lit(size)))


def padded(rows: DataFrame, batch: str, multiple: int = 8, columns: dict[str, int] | None = None) -> DataFrame:
    """The id columns filled up to their batch's longest row, rounded up to a multiple."""
    columns = columns or {"input_ids": PAD, "attention_mask": 0, "labels": IGNORE}
    first = next(iter(columns))
    longest = rows.groupBy(batch).agg((F.ceil(F.max(F.size(first)) / multiple) * multiple).cast("int").alias("__to"))
    out = rows.join(longest, batch)
    return out.withColumns({c: F.concat(c, F.array_repeat(F.lit(v), F.col("__to") - F.size(c))) for c, v in columns.items()}).drop("__to")


def pairwise_batch(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """Chosen rows of a batch, then its rejected rows, as input_ids, labels and place."""
    of = lambda name, k: rows.select(batch, order, F.lit(k).alias("side"), F.col(f"{name}_input_ids").alias("input_ids"), F.col(f"{name}_labels").alias("labels"))
    both = of("chosen", 0).unionByName(of("rejected", 1)).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return padded(both, batch)


def feedback_batch(rows: DataFrame, batch: str, multiple: int = 8) -> DataFrame:
    """A batch with its answers and its mismatched answers, each padded on its own."""
    out = padded(rows, batch, multiple, {"input_ids": PAD, "labels": IGNORE})
    return padded(out, batch, multiple, {"kl_input_ids": PAD, "kl_labels": IGNORE})


#: The encoder of each stage; preference training loads data as reward modelling does.
STAGES = {"pt": blocks, "sft": supervised, "rm": pairwise, "dpo": pairwise, "kto": feedback, "ppo": unsupervised}


def encoder(stage: str):
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    return STAGES[stage]
