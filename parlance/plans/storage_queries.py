"""Queries that write tables with the sinks and read them again with the scans, and checks of tables against each other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import words
from parlance.operators import curate, judge, split, validate
from parlance.plans.registry import Tables, query
from parlance.sources import scan, sinks, stages
from parlance.streaming import streams


def folder(t: Tables, name: str) -> str:
    return f"{stages.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT turn, conv_id, text, role FROM conversations")
def csv_round_trip(t: Tables) -> DataFrame:
    path = folder(t, "csv")
    sinks.write_csv(t.conversations, path, ["turn", "conv_id", "text", "role"])
    return scan.read_csv(t.spark, path, "turn long, conv_id long, text string, role string")


@query("SELECT event_id, value, value / 3 AS third FROM events")
def csv_doubles(t: Tables) -> DataFrame:
    """Doubles as text, which read back to the last bit."""
    path = folder(t, "csv")
    sinks.write_csv(t.events.withColumn("third", F.col("value") / 3), path, ["event_id", "value", "third"])
    return scan.read_csv(t.spark, path, "event_id long, value double, third double")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_lines_round_trip(t: Tables) -> DataFrame:
    path = folder(t, "json")
    sinks.write_json_lines(t.documents, path)
    return scan.read_json(t.spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_round_trip(t: Tables) -> DataFrame:
    path = folder(t, "json")
    sinks.write_json_array(t.nation, path, "n_nationkey")
    return scan.read_json(t.spark, path, "n_nationkey int, n_name string, n_regionkey int", array=True)


@query("SELECT kind, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('parquet'), ('txt')) AS k(kind)")
def any_format(t: Tables) -> DataFrame:
    """One table in files of four types, each read by its type."""
    path, rows = folder(t, "formats"), t.nation.select("n_nationkey", "n_name")
    sinks.write_csv(rows, f"{path}/csv", ["n_nationkey", "n_name"])
    sinks.write_json_lines(rows.coalesce(1), f"{path}/json")
    sinks.write_tokens(rows, f"{path}/parquet")
    rows.select(F.concat_ws("\t", "n_nationkey", "n_name").alias("value")).write.text(f"{path}/txt")
    text = scan.read_any(t.spark, f"{path}/txt").select(F.split("text", "\t").alias("x")).select(F.get("x", F.lit(0)).alias("n_nationkey"), F.get("x", F.lit(1)).alias("n_name"))
    read = {"csv": scan.read_any(t.spark, f"{path}/csv"), "parquet": scan.read_any(t.spark, f"{path}/parquet"), "json": scan.read_json(t.spark, f"{path}/json"), "txt": text}
    return split.concatenated([df.select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name") for kind, df in read.items()])


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 5 THEN 'test' ELSE 'train' END AS split FROM supplier")
def held_out_ids(t: Tables) -> DataFrame:
    """Rows split by a file of held-out ids, a JSON array of texts."""
    path = folder(t, "ids")
    t.supplier.where("s_nationkey < 5").agg(F.to_json(F.collect_list(F.col("s_suppkey").cast("string"))).alias("value")).coalesce(1).write.text(path)
    ids = scan.held_out_ids(t.spark, path, "id").select(F.col("id").cast("long").alias("s_suppkey"))
    train, test = split.by_ids(t.supplier, ids, "s_suppkey")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))).select("s_suppkey", "s_name", "split")


@query("""SELECT text AS question, 'first, ' || item_id AS "A", 'say "' || item_id || '"' AS "B", CAST(item_id AS VARCHAR) AS "C", 'none' AS "D", substr('ABCD', 1 + item_id % 4, 1) AS answer FROM benchmark""")
def mcq_scan(t: Tables) -> DataFrame:
    """Headerless question files."""
    path, n = folder(t, "mcq"), F.col("item_id").cast("string")
    rows = t.benchmark.select(F.col("text").alias("question"), F.concat(F.lit("first, "), n).alias("A"), F.concat(F.lit('say "'), n, F.lit('"')).alias("B"), n.alias("C"), F.lit("none").alias("D"), F.expr("substr('ABCD', 1 + item_id % 4, 1)").alias("answer"))
    rows.write.option("escape", '"').csv(path)
    return scan.read_mcq(t.spark, path)


@query("SELECT conv_id, turn, 'a' AS prompt, text AS label, array_to_string(list_concat(list_transform(range(1, 2 + turn % 3), lambda k: k + 4), list_transform(range(conv_id % 4), lambda k: 0)), ',') AS predict FROM conversations")
def predictions_sink(t: Tables) -> DataFrame:
    """Predicted ids whose leading fill goes to the end, written and read again."""
    path = folder(t, "predictions")
    fill = F.array_repeat(F.lit(0), (F.col("conv_id") % 4).cast("int"))
    ids = F.concat(fill, F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("turn") % 3), lambda k: (k + 4).cast("int")))
    rows = t.conversations.withColumn("predict", F.concat_ws("|", "conv_id", "turn", F.array_join(sinks.fill_last(ids, 0), ",")))
    sinks.write_predictions(rows.withColumns({"prompt": F.lit("a"), "label": F.col("text")}), path)
    part = F.split("predict", r"\|")
    read = scan.read_json(t.spark, path, "prompt string, predict string, label string")
    return read.select(F.get(part, F.lit(0)).cast("long").alias("conv_id"), F.get(part, F.lit(1)).cast("long").alias("turn"), "prompt", "label", F.get(part, F.lit(2)).alias("predict"))


@query("SELECT round(o_totalprice, 2) AS chosen, round(o_totalprice / 3, 2) AS rejected FROM orders")
def reward_predictions_sink(t: Tables) -> DataFrame:
    path = folder(t, "rewards")
    sinks.write_reward_predictions(t.orders.select(F.col("o_totalprice").alias("chosen"), (F.col("o_totalprice") / 3).alias("rejected")), path)
    return scan.read_json(t.spark, path, "chosen double, rejected double")


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS INTEGER) AS n_ids, n_chars FROM documents")
def tokens_saved(t: Tables) -> DataFrame:
    """A tokenised table, saved and loaded as it is."""
    path = folder(t, "tokens")
    ids = F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.length(w))
    sinks.write_tokens(t.documents.select("doc_id", "n_chars", ids.alias("input_ids")), path)
    return scan.prepared(t.spark, path).select("doc_id", F.size("input_ids").alias("n_ids"), "n_chars")


@query("SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def summary_sink(t: Tables) -> DataFrame:
    path = folder(t, "summary")
    sinks.write_summary(t.events.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), path)
    return scan.read_json(t.spark, path, "n long, mean double, model string").select("model", "n", F.round("mean", 6).alias("mean"))


@query("SELECT event_id AS step, 1 + CAST(event_type = 'click' AS INTEGER) + CAST(value > 50 AS INTEGER) AS n_keys, event_type = 'click' AS has_loss FROM events")
def training_log(t: Tables) -> DataFrame:
    """Log records that are appended twice, without their nulls."""
    path = folder(t, "log")
    rows = t.events.select(F.col("event_id").alias("current_steps"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"), F.when(F.col("value") > 50, F.col("user_id")).alias("lr"))
    sinks.append_log(rows.where("loss IS NULL"), path)
    sinks.append_log(rows.where("loss IS NOT NULL"), path)
    keys = F.json_object_keys("value")
    return t.spark.read.text(path).select(F.get_json_object("value", "$.current_steps").cast("long").alias("step"), F.size(keys).alias("n_keys"), F.array_contains(keys, "loss").alias("has_loss"))


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE n_chars >= 500) AS left_over FROM documents")
def resumed_run(t: Tables) -> DataFrame:
    """An output that a run left unfinished: the next one writes the rest, and a third one nothing."""
    path, rows = folder(t, "parts"), t.documents.select("doc_id", "n_chars")
    sinks.write_in_parts(rows.where("n_chars < 500"), path, "doc_id")
    n = sinks.write_in_parts(rows, path, "doc_id")
    sinks.write_in_parts(rows, path, "doc_id")
    return stages.cached(t.spark, path, lambda: rows).withColumn("left_over", F.lit(n).cast("long"))


@query("SELECT conv_id * 100 + turn AS id, 1 + CAST(role <> 'system' AS BIGINT) AS judges, CASE WHEN turn = 3 AND role <> 'system' THEN 2::BIGINT ELSE 1::BIGINT END AS contents FROM conversations WHERE turn = 3 OR role = 'system'")
def unlike_judges(t: Tables) -> DataFrame:
    """Rows that two judges describe differently, or only one does."""
    a = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "role", "text")
    b = a.where("role <> 'system'").withColumn("text", F.when(F.col("turn") == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return validate.aligned({"a": a, "b": b}, "id", "text")


@query("""SELECT doc_id, 'second' AS only_in FROM documents ANTI JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'first' FROM labels ANTI JOIN documents USING (doc_id)""")
def ids_on_one_side(t: Tables) -> DataFrame:
    return validate.same_ids(t.labels, t.documents, "doc_id")


@query("SELECT user_id, count(DISTINCT event_id % 3) AS sizes FROM events GROUP BY user_id HAVING count(DISTINCT event_id % 3) > 1")
def unequal_counts(t: Tables) -> DataFrame:
    """Users whose judges scored different numbers of responses."""
    rates = t.events.select("user_id", "event_type", F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3).alias("responses"))
    return validate.same_counts(rates, "user_id", "event_type", "responses")


_ARGUMENTS = {
    "plain": (dict(datasets=("a",)), True), "share_without_sets": (dict(val_size=0.1), False), "share_and_sets": (dict(datasets=("a",), eval_datasets=("b",), val_size=0.1), False), "chances_of_concat": (dict(datasets=("a",), probabilities=(1.0,)), False),
    "chances": (dict(datasets=("a", "b"), mix="interleave_under", probabilities=(0.5, 0.5)), True), "too_few_chances": (dict(datasets=("a", "b"), mix="interleave_over", probabilities=(0.5,)), False), "stream_share": (dict(datasets=("a",), streaming=True, val_size=0.1), False),
    "stream_rows": (dict(datasets=("a",), streaming=True, val_size=100), True), "stream_samples": (dict(streaming=True, max_samples=5), False), "masked_and_on_prompt": (dict(mask_history=True, train_on_prompt=True), False), "unknown_mix": (dict(mix="other"), False),
}


def accepted(f, *args, **how) -> bool:
    try:
        f(*args, **how)
    except Exception:
        return False
    return True


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(ok).lower()})" for k, (_, ok) in _ARGUMENTS.items()) + ", ('columns', true), ('lacking', false), ('set', true), ('other_set', false), ('same', true), ('changed', false)) AS v(name, accepted)")
def argument_checks(t: Tables) -> DataFrame:
    """Which arguments and tables the checks accept."""
    rows = t.nation.withColumn("set", F.lit("rm-prompt"))
    found = {name: accepted(validate.DataArguments, **how) for name, (how, _) in _ARGUMENTS.items()}
    found |= {"columns": accepted(validate.required_columns, rows, ["n_name", "set"]), "lacking": accepted(validate.required_columns, rows, ["n_name", "gone"])}
    found |= {"set": accepted(lambda: validate.with_set(rows, "rm-prompt").collect()), "other_set": accepted(lambda: validate.with_set(rows, "sft-demonstration").collect())}
    found |= {"same": validate.same_table(t.nation, t.nation.repartition(3)), "changed": validate.same_table(t.nation, t.nation.where("n_nationkey > 0"))}
    return t.spark.createDataFrame(list(found.items()), "name string, accepted boolean")


@query("SELECT event_id, value, event_id * 2 AS predict_sft_0, upper(event_type) AS predict_sft_1 FROM events WHERE event_type <> 'error'")
def predictions_by_place(t: Tables) -> DataFrame:
    """Rows with the predictions of two files at their places; the shorter file ends the join."""
    files = [t.events.select("event_id", (F.col("event_id") * 2).alias("predict")), t.events.where("event_type <> 'error'").select("event_id", F.upper("event_type").alias("predict"))]
    return curate.joined_by_place(t.events.select("event_id", "value"), files, "event_id")


_MODELS = ("click", "purchase", "view")


@query("SELECT user_id AS dialogue_id, " + ", ".join(f"max(CASE WHEN event_type = '{m}' THEN {c} END) AS predict_sft_{m}_{n}" for m in _MODELS for n, c in (("0", "first"), ("candidate", "candidate"))) + """
FROM (SELECT user_id, event_type, CAST(min(event_id) AS VARCHAR) AS first, CAST(max(event_id) AS VARCHAR) AS candidate FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY ALL) GROUP BY user_id HAVING count(*) = 3""")  # fmt: skip
def wide_models(t: Tables) -> DataFrame:
    """A row for each user that all three models have, with the first and the chosen candidate of each."""
    rows = t.events.where(F.col("event_type").isin(*_MODELS)).groupBy(F.col("user_id").alias("dialogue_id"), F.col("event_type").alias("model")).agg(F.min("event_id").cast("string").alias("0"), F.max("event_id").cast("string").alias("candidate"))
    return curate.wide_models(rows, list(_MODELS))


@query("SELECT l.doc_id, l.quality, f.event_id, f.event_type FROM labels l JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id) = 1) f ON l.doc_id % 97 = f.event_id % 97")
def mandatory_lookup(t: Tables) -> DataFrame:
    """Labels with the first event of their key; a key without one would fail the job."""
    rows, source = t.labels.withColumn("key", F.col("doc_id") % 97), t.events.select((F.col("event_id") % 97).alias("key"), "event_id", "event_type")
    return judge.mandatory_lookup(rows, source, "key", "event_id").select("doc_id", "quality", "event_id", "event_type")


_SETS = "CASE event_type WHEN 'view' THEN 'ppo-unlabeled-prompts' WHEN 'click' THEN 'sft-demonstration' WHEN 'error' THEN 'other' ELSE 'rm-prompt' END"


@query(f"""SELECT event_id, row_number() OVER (ORDER BY CASE s WHEN 'sft-demonstration' THEN 0 WHEN 'rm-prompt' THEN 1 WHEN 'ppo-unlabeled-prompts' THEN 2 ELSE 3 END, event_id) AS place FROM (SELECT event_id, {_SETS} AS s FROM events)""")
def merged_sets(t: Tables) -> DataFrame:
    """The places of rows in a merged table: by set, and in their own order in each set."""
    rows = t.events.select("event_id", F.expr(_SETS).alias("set"))
    parts = [rows.where(F.col("set") == s) for s in ("other", "ppo-unlabeled-prompts", "rm-prompt", "sft-demonstration")]
    ordered = split.merged(parts, "event_id").select("event_id", F.monotonically_increasing_id().alias("__m"))
    return split.numbered(ordered, ["__m"], "place").select("event_id", "place")


@query("""WITH RECURSIVE src AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_type IN ('click', 'view', 'error')),
chance AS (SELECT k AS position, ('0x' || substr(md5(k || '|42'), 1, 8))::BIGINT / 4294967296 AS c FROM range((SELECT 20 * max(n) + 1000 FROM src)) x(k)),
place AS (SELECT position, CASE WHEN c < 0.5 THEN 'click' WHEN c < 0.75 THEN 'view' ELSE 'error' END AS event_type FROM chance),
nth AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY position) AS r FROM place),
stop AS (SELECT min(position) AS last FROM nth JOIN (SELECT DISTINCT event_type, n FROM src) s ON nth.event_type = s.event_type AND nth.r = s.n)
SELECT position, src.event_id, src.event_type FROM nth JOIN src USING (event_type, r) WHERE position <= (SELECT last FROM stop)""")
def interleave_drawn(t: Tables) -> DataFrame:
    """Events of three types drawn by chance, until the first type ends."""
    return split.drawn(t.events.select("event_type", "event_id"), "event_type", "event_id", {"click": 2.0, "view": 1.0, "error": 1.0}).select("position", "event_id", "event_type")


@query("SELECT doc_id, n_chars, md5(doc_id || '|42-0') AS place FROM documents")
def stream_shuffled(t: Tables) -> DataFrame:
    """A stream's rows in the seeded order of their micro-batch, written and read again."""
    path = folder(t, "shuffled")
    t.documents.select("doc_id", "n_chars").write.parquet(f"{path}/in")
    rows = streams.read_stream(t.spark, f"{path}/in", "doc_id long, n_chars long", files_at_once=1_000_000)
    seen: list[dict] = []
    listener = streams.progress(seen.append)
    t.spark.streams.addListener(listener)
    try:
        streams.write_shuffled(rows, f"{path}/out", f"{path}/checkpoint", "doc_id").awaitTermination()
    finally:
        t.spark.streams.removeListener(listener)
    return t.spark.read.parquet(f"{path}/out/batch=0").select("doc_id", "n_chars", split.seeded("doc_id", "42-0").alias("place"))
