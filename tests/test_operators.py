"""Operators over small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from parlance.functions import providers
from parlance.operators import align, curate, encode, judge, metrics, pack, parse, reshape, split, templates, tools, validate
from parlance.sources import registry, scan, sinks, stages
from parlance.streaming import streams

CALL = {"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}
WRITTEN = {
    "default": 'Action: tool_name\nAction Input: {"foo": "bar", "size": 10}\n',
    "glm4": 'tool_name\n{"foo": "bar", "size": 10}',
    "llama3": '{"name": "tool_name", "parameters": {"foo": "bar", "size": 10}}',
    "mistral": '[{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}]',
    "qwen": '<tool_call>\n{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}\n</tool_call>',
}
TOOL = {"name": "test_tool", "description": "tool_desc", "parameters": {"type": "object", "properties": {"foo": {"type": "string", "description": "foo_desc"}, "bar": {"type": "number", "description": "bar_desc"}}, "required": ["foo"]}}


@pytest.mark.parametrize("dialect", WRITTEN)
def test_tool_calls(spark, dialect):
    rows = spark.createDataFrame([(json.dumps(CALL), WRITTEN[dialect])], "call string, text string")
    got = rows.select(tools.written(dialect, F.col("call")).alias("w"), tools.extract(dialect, F.col("text")).alias("x")).first()
    assert got["w"] == WRITTEN[dialect]
    assert [tuple(c) for c in got["x"]["calls"]] == [("tool_name", '{"foo": "bar", "size": 10}')]
    assert tools.calls_of(dialect, "nothing to call") is None
    assert tools.tools_text(dialect, "") == ""
    assert "test_tool" in tools.tools_text(dialect, json.dumps([TOOL]), "01 Jan 2024")


def test_tool_calls_that_a_dialect_lacks():
    two = json.dumps([CALL, CALL])
    for dialect in ("glm4", "llama3"):
        with pytest.raises(ValueError, match="parallel"):
            tools.calls_text(dialect, two)
    assert len(tools.calls_of("default", tools.calls_text("default", two))) == 2
    assert tools.calls_text("qwen", "<think>\nso\n</think>\n" + json.dumps(CALL)).startswith("<think>\nso\n</think>\n<tool_call>")
    assert "  - foo (string, required): foo_desc\n  - bar (number): bar_desc\n" in tools.tools_text("default", json.dumps([TOOL]))


def test_instructions(spark):
    rows = spark.createDataFrame([(1, "ask", "more", "yes", [("u", "a")], True), (2, "", None, None, None, None)], "id int, instruction string, input string, output string, history array<struct<user:string,assistant:string>>, tag boolean")
    got = align.from_instructions(rows, align.Columns(history="history"), ["id"]).orderBy("id").collect()
    assert [m["content"] for m in got[0]["_prompt"]] == ["u", "a", "ask\nmore"]
    assert [m["content"] for m in got[0]["_response"]] == ["yes"]
    assert [m["content"] for m in got[1]["_prompt"]] == [""] and got[1]["_response"] == []
    judged = align.from_instructions(rows, align.Columns(kto_tag="tag"), ["id"]).orderBy("id").collect()
    assert [m["content"] for m in judged[0]["_response"]] == ["yes", ""]


def test_messages(spark):
    said = lambda *roles: [(r, f"{r}{k}") for k, r in enumerate(roles)]
    rows = [(1, said("system", "human", "gpt")), (2, said("human", "human")), (3, said("human", "gpt", "human")), (4, None), (5, said("human", "function_call", "observation", "gpt"))]
    df = spark.createDataFrame(rows, "id int, conversations array<struct<`from`:string,value:string>>")
    got = {r["id"]: r for r in align.from_messages(df, align.Columns(), ["id"]).collect()}
    assert [m["role"] for m in got[1]["_prompt"]] == ["user"] and got[1]["_system"] == "system0"
    assert got[2]["_prompt"] == [] and got[3]["_prompt"] == [] and got[4]["_prompt"] == []
    assert [m["role"] for m in got[5]["_prompt"]] == ["user", "function", "observation"]
    assert align.well_formed(align.from_messages(df, align.Columns(), ["id"]), "sft").count() == 2
    ranked = df.where("id = 3").withColumns({"good": F.expr("named_struct('from', 'gpt', 'value', 'g')"), "bad": F.expr("named_struct('from', 'gpt', 'value', 'b')")})
    both = align.from_messages(ranked, align.Columns(ranking=True, chosen="good", rejected="bad"), ["id"]).first()
    assert len(both["_prompt"]) == 3 and [m["content"] for m in both["_response"]] == ["g", "b"]
    with pytest.raises(ValueError):
        align.check_stage("rm", False)


def test_media_paths(spark):
    rows = spark.createDataFrame([(1, ["a.png", "b.png"]), (2, None)], "id int, _images array<string>")
    files = spark.createDataFrame([("/m/a.png",)], "path string")
    got = {r["id"]: r["_images"] for r in align.with_media_paths(rows, files, "/m").collect()}
    assert got == {1: ["/m/a.png", "b.png"], 2: None}


COMPLETION = "Dialogue 1:\n(JOY) hi\n(CALM) well\n(FEAR) x\nStep 2: why\nStep 3: thus\n(NEUTRAL) and?\nno brackets\nDialogue 3:\n(SAD) oh\n"


def test_completions(spark):
    rows = spark.createDataFrame([(1, COMPLETION), (2, "nothing"), (3, "Dialogue 2:\n(A) b")], "pos int, completion string")
    got = parse.segments(rows, "completion", "pos").collect()
    users = sorted((r["UID"], r["SEG"], r["EMOTION"][0], r["RESPONSE_2"]) for r in got if r["SID"] == "USER")
    assert users == [("CHATGPT-000000-0000", "hi", "JOY", "thus"), ("CHATGPT-000000-0002", "None", "None", "None"), ("CHATGPT-000001-0000", "oh", "SAD", "None"), ("CHATGPT-000002-0000", "b", "A", "None")]
    both = rows.select(parse.two_dialogues(F.lit("Dialogue 1: abc")).alias("x"), parse.two_dialogues(F.lit("Dialogue 1: abc"), True).alias("y")).first()
    assert both["x"] == ["abc", ""] and both["y"] == ["ab", ""]


def test_templates(spark):
    rows = spark.createDataFrame([([("user", "How are you"), ("assistant", "I am fine!"), ("user", "你好"), ("assistant", "很高兴认识你！")],)], "m array<struct<role:string,content:string>>")
    got = rows.select(*[templates.render(t, F.col("m"), F.lit("")).alias(n) for n, t in templates.TEMPLATES.items()], templates.render(templates.TEMPLATES["llama2"], F.col("m"), F.lit("S")).alias("with_system")).first()
    assert got["llama3"][0] == "<s><|start_header_id|>user<|end_header_id|>\n\nHow are you<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
    assert got["with_system"][0] == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nHow are you [/INST]"
    assert got["chatml"][2] == "<|im_start|>user\n你好<|im_end|>\n<|im_start|>assistant\n"
    assert all(len(x) == 4 for x in got)
    with pytest.raises(ValueError):
        templates.Template(user="no place")
    assert "message['role'] == 'user'" in templates.jinja(templates.TEMPLATES["qwen"])


def test_questions(spark):
    row = ("Fewshot question", "A0", "B0", "C0", "D0", "B")
    df = spark.createDataFrame([row], "question string, A string, B string, C string, D string, answer string")
    got = df.select(templates.mcq_messages("en", F.array(templates.example()), templates.example(), F.lit("SubName")).alias("m")).first()["m"]
    asked = "Fewshot question\nA. A0\nB. B0\nC. C0\nD. D0\nAnswer:"
    assert [m["content"] for m in got] == ["The following are multiple choice questions (with answers) about SubName.\n\n" + asked, "B", asked, "B"]


def test_prompts(spark):
    rows = spark.createDataFrame([("tea", [[("JOY", "CALM"), ("FEAR", "JOY")], [("SAD", "CALM")]], [("q1", "a1")])], "topic string, e array<array<struct<human:string,chatbot:string>>>, done array<struct<prompt:string,completion:string>>")
    got = rows.select(
        templates.generation_request("S", "I", "X", "Dialogue {k} on {topic}: {turns}", F.col("topic"), F.col("e")).alias("m"), templates.family_prompt("inst", "go ", F.col("done"), F.lit("q2")).alias("p"),
        templates.system_prompt(F.array(F.lit("JOY"), F.lit("FEAR")), ("be ", " and ", ".")).alias("s"), templates.placeholders_match(F.lit([]).cast("array<struct<role:string,content:string>>"), "<image>", F.lit([]).cast("array<string>")).alias("none"),
    ).first()
    assert got["m"][1]["content"] == "I\nX\nDialogue 1 on tea: JOY - CALM; FEAR - JOY\nDialogue 2 on tea: SAD - CALM"
    assert got["p"] == "go [INST] q1 [/INST] a1</s>[INST] q2 [/INST] " and got["s"] == "be JOY and FEAR." and got["none"]


def test_encoding(spark):
    turns = [([11, 12, 13], [14, 2]), ([15], [16, 17, 2])]
    df = spark.createDataFrame([(turns,)], "turns array<struct<source:array<int>,target:array<int>>>")
    plain = encode.supervised(df, 100).first()
    assert plain["input_ids"] == [11, 12, 13, 14, 2, 15, 16, 17, 2] and plain["labels"] == [-100, -100, -100, 14, 2, -100, 16, 17, 2]
    last = encode.supervised(df, 100, mask_history=True).first()
    assert last["labels"] == [-100, -100, -100, -100, -100, -100, 16, 17, 2] and last["input_ids"] == plain["input_ids"]
    assert encode.supervised(df, 100, train_on_prompt=True).first()["labels"] == plain["input_ids"]
    assert len(encode.supervised(df, 4).first()["input_ids"]) == 4
    assert encode.supervised(df, 100, efficient_eos=True).first()["labels"][0] == 2


def test_padding(spark):
    df = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5], [1] * 6, [-100, -100, 2, 3, 4, 5]), (0, [6, 7], [1, 1], [-100, 7])], "batch int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    got = sorted(encode.padded(df, "batch").collect(), key=lambda r: -sum(r["attention_mask"]))
    assert got[1]["labels"] == [-100, 7, *[-100] * 6] and len(got[0]["input_ids"]) == 8 and got[1]["attention_mask"] == [1, 1, *[0] * 6]


def test_pairwise_and_feedback(spark):
    df = spark.createDataFrame([(0, 1, [9] * 4, [7] * 3, [8] * 5), (0, 2, [9], [7], [8])], "batch int, id int, p array<int>, c array<int>, r array<int>")
    coded = encode.pairwise(df, "p", "c", "r", 100)
    assert coded.where("id = 1").first()["rejected_labels"] == [-100] * 4 + [8] * 5
    batch = encode.pairwise_batch(coded, "batch", "id").orderBy("side", "id").collect()
    assert [r["side"] for r in batch] == [0, 0, 1, 1] and len({len(r["input_ids"]) for r in batch}) == 1
    mixed = encode.mismatched(df, "batch", "id", ["c"]).orderBy("id").collect()
    assert [r["kl_c"] for r in mixed] == [[7], [7] * 3]
    both = encode.feedback(encode.mismatched(df, "batch", "id", ["c"]), "p", "c", "kl_c", 100)
    assert both.where("id = 2").first()["kl_labels"] == [-100] + [7] * 3
    assert encode.encoder("dpo") is encode.encoder("rm")


def test_packed_sequences(spark):
    df = spark.createDataFrame([(0, 1, 3, [1] * 3, [1] * 3), (0, 2, 4, [2] * 4, [2] * 4), (0, 3, 9, [3] * 9, [3] * 9)], "batch int, id int, n int, input_ids array<int>, labels array<int>")
    plan = pack.packed(df, "batch", "id", "n", 9)
    assert {r["id"] for r in plan.collect()} == {1, 2}
    got = pack.sequences(df, plan, "batch", "id", 9).first()
    assert got["input_ids"] == [2] * 4 + [1] * 3 + [0] * 2 and got["attention_mask"] == [1] * 4 + [2] * 3 + [0] * 2


def test_splits(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 3, "few").when(F.col("id") < 700, "hot").otherwise("rest"))
    got = split.stratified(df, ["s"], "id", 4)
    assert {r["s"]: r["n"] for r in got.where("split = 'test'").groupBy("s").agg(F.count("*").alias("n")).collect()} == {"hot": 4, "rest": 4}
    with pytest.raises(Exception, match="too small"):
        split.stratified(df, ["s"], "id", 4, on_small="raise").collect()
    assert split.train_validation(df, "id", 0.25).where("split = 'validation'").count() == 250
    assert split.train_validation(df, "id", 7).where("split = 'validation'").count() == 7
    assert [split.sample_n(df, "id", n).count() for n in (10, 1000, 2500)] == [10, 1000, 2500]
    assert sorted(r["rn"] for r in split.ranked(df, "id", 1).collect()) == list(range(1, 1001))
    assert [r["id"] for r in split.numbered(df, ["id"]).orderBy("rn").collect()] == list(range(1000))
    totals = split.running_total(df, ["id"], F.col("id"), "t", "s").orderBy("id").collect()
    assert [r["t"] for r in totals[:5]] == [0, 1, 3, 3, 7] and totals[-1]["t"] == sum(range(700, 1000))
    assert {r["s"]: r["n"] for r in split.per_group(df, "s", "id", 5).groupBy("s").agg(F.count("*").alias("n")).collect()} == {"few": 3, "hot": 5, "rest": 5}
    pairs = split.pair_schedule(spark, ("A", "B", "C"), 2, 4).collect()
    assert len(pairs) == 18 and len({(r["human"], r["chatbot"]) for r in pairs}) == 9
    train, test = split.by_ids(df, spark.range(5), "id")
    assert (train.count(), test.count()) == (995, 5)


def test_mixtures(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", k) for k in range(2)], "s string, k int")
    assert split.interleaved(df, "s", "k").count() == 4
    over = split.interleaved(df, "s", "k", "all_exhausted")
    assert {r["s"]: r["n"] for r in over.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 5}
    first = split.drawn(df, "s", "k", {"a": 0.5, "b": 0.5}, 1).orderBy("position").collect()
    assert [r["position"] for r in first] == list(range(len(first))) and (first[-1]["s"], first[-1]["k"]) in (("a", 4), ("b", 1))
    assert [r["k"] for r in first if r["s"] == "a"] == list(range(sum(r["s"] == "a" for r in first)))
    every = split.drawn(df, "s", "k", {"a": 0.9, "b": 0.1}, 1, "all_exhausted").collect()
    assert {(r["s"], r["k"]) for r in every} == {(r["s"], r["k"]) for r in df.collect()}
    with pytest.raises(ValueError):
        split.drawn(df, "s", "k", {"a": 0.5, "c": 0.5})
    sets = [spark.createDataFrame([(1, "rm-prompt")], "pos int, set string"), spark.createDataFrame([(2, "sft-demonstration")], "pos int, set string")]
    assert [r["pos"] for r in split.merged(sets, "pos").collect()] == [2, 1]


def test_curation(spark):
    df = spark.createDataFrame([("d", ["t0", "t1", "t2", "t3"], [0.5, 0.1, 0.4, 0.1], "m", "x")], "id string, candidates array<string>, scores array<double>, modified string, label string")
    got = df.select(curate.best(F.col("scores")).alias("b"), curate.bottom(F.col("scores")).alias("w")).first()
    assert got["b"] == 1 and got["w"] == [1, 3, 2]
    less = curate.drop_one_of_worst(df, "id").first()
    assert len(less["candidates"]) == 3 and less["dropped"] in (1, 2, 3) and "t0" in less["candidates"]
    kept = curate.negatives(df, "id", F.lit(False), "modified", "label").first()
    assert kept["modified"] is None and kept["label"] == "None" and len(kept["scores"]) == 4
    assert df.select(curate.replaced_segment(F.col("candidates"), F.lit(1), F.lit("X")).alias("x")).first()["x"] == "t0 X t2 t3"
    places = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, q string")
    guess = [spark.createDataFrame([(0, "x"), (1, "y")], "pos int, predict string"), spark.createDataFrame([(0, "z")], "pos int, predict string")]
    assert [tuple(r) for r in curate.joined_by_place(places, guess).collect()] == [(0, "a", "x", "z")]
    models = spark.createDataFrame([("d", "m1", "f1", "c1"), ("d", "m2", "f2", "c2"), ("e", "m1", "f", "c")], "dialogue_id string, model string, first string, candidate string")
    assert [r["predict_sft_m2_candidate"] for r in curate.wide_models(models, ["m1", "m2"], "first").collect()] == ["c2"]
    sweep = curate.weight_sweep(spark.createDataFrame([(0.1, 0.5, 0.2), (0.3, 0.1, 0.9)], "similarity double, distinct double, length double"), [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0)])
    assert tuple(curate.sweep_choice(sweep).first()["by_mean"]) == (1.0, 0.0, 0.0)


def test_lookups(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    found = judge.mandatory_lookup(rows.select("id"), rows, "id", "v")
    assert found.count() == 2
    with pytest.raises(Exception, match="no row"):
        judge.mandatory_lookup(spark.createDataFrame([("q",)], "id string"), rows, "id", "v").collect()


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), ("b", "b")], "y_true string, y_pred string")
    got = metrics.classification(rows, []).first()
    assert (got["hits"], got["total"]) == (2, 4) and got["f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    words = spark.createDataFrame([("the cat sat on the mat", "the cat on the mat")], "a string, b string")
    scores = words.select(metrics.rouge_l("a", "b").alias("l"), metrics.bleu_4("a", "a").alias("b")).first()
    assert scores["l"] == pytest.approx(100 * 10 / 11, abs=1e-3) and scores["b"] == 100
    acc = metrics.token_accuracy(spark.createDataFrame([([1, 2, 3, 9], [0, 1, -100, 4])], "pred array<int>, labels array<int>")).first()
    assert acc["accuracy"] == 0.5


def test_validation(spark):
    a, b = spark.range(4), spark.range(1, 5)
    assert {(r["id"], r["only_in"]) for r in validate.same_ids(a, b, "id").collect()} == {(0, "first"), (4, "second")}
    with pytest.raises(ValueError):
        validate.require_none(validate.repeated(a.union(b), "id"), "repeated")
    assert validate.same_table(a, spark.range(4)) and not validate.same_table(a, b)
    assert validate.aligned({"x": a.withColumn("p", F.lit("q")), "y": b.withColumn("p", F.lit("q"))}, "id", "p").count() == 2
    for wrong in ({"mix": "no"}, {"val_size": 0.1}, {"datasets": ("a",), "probabilities": (1.0,)}, {"streaming": True, "max_samples": 3}, {"mask_history": True, "train_on_prompt": True}):
        with pytest.raises(ValueError):
            validate.DataArguments(**wrong)
    with pytest.raises(Exception, match="unexpected set"):
        validate.with_set(spark.createDataFrame([("x",)], "set string"), "y").collect()


def test_registry_and_files(spark, tmp_path):
    info = {
        "plain": {"file_name": "plain.json"},
        "chat": {"file_name": "chat.jsonl", "formatting": "sharegpt", "columns": {"messages": "said"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"}},
        "bare": {"file_name": "plain.json", "columns": {"prompt": "instruction"}},
        "far": {"hf_hub_url": "a/b", "file_name": "c"},
    }
    (tmp_path / "dataset_info.json").write_text(json.dumps(info))
    (tmp_path / "plain.json").write_text(json.dumps([{"instruction": "i", "input": "", "output": "o"}], indent=1))
    (tmp_path / "chat.jsonl").write_text(json.dumps({"said": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}) + "\n")
    assert registry.resolve("bare", info).columns.response is None and registry.resolve("plain", info).columns.response == "output"
    assert registry.resolve("far", info).load_from == "hub"
    with pytest.raises(ValueError):
        registry.resolve("none", info)
    got = registry.aligned(spark, ["plain", "chat"], str(tmp_path), "sft").collect()
    assert {(r["dataset"], r["_response"][0]["content"]) for r in got} == {("plain", "o"), ("chat", "a")}
    with pytest.raises(ValueError):
        scan.kind_of(["a.csv", "b.json"])
    (tmp_path / "ids.json").write_text('["x", "y"]')
    assert scan.held_out_ids(spark, str(tmp_path / "ids.json")).count() == 2
    (tmp_path / "hh.jsonl").write_text(json.dumps({"chosen": "\n\nHuman: q\n\nAssistant: yes", "rejected": "\n\nHuman: q\n\nAssistant: no"}) + "\n")
    assert tuple(scan.read_preferences(spark, str(tmp_path / "hh.jsonl")).first()) == ([], "q", "yes", "no")
    (tmp_path / "multi.jsonl").write_text(json.dumps({"instruction": "Human:a\nAssistant:b\nHuman:c", "output": "d"}) + "\n")
    assert [m["value"] for m in scan.read_multiturn(spark, str(tmp_path / "multi.jsonl")).first()["conversations"]] == ["a", "b", "c", "d"]
    (tmp_path / "ultra.jsonl").write_text(json.dumps({"id": "1", "data": ["a", "b", "c"]}) + "\n" + json.dumps({"id": "2", "data": ["a"]}) + "\n")
    assert scan.read_alternating(spark, str(tmp_path / "ultra.jsonl")).count() == 1


def test_sinks_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", 0.1), (2, None, 1 / 3)], "id int, t string, x double")
    sinks.write_csv(df, f"{tmp_path}/csv", ["t", "x", "id"])
    back = scan.read_csv(spark, f"{tmp_path}/csv", "t string, x double, id int")
    assert sorted((r["id"], r["t"], r["x"]) for r in back.collect()) == [(1, "a,\"b\"\nc", 0.1), (2, None, 1 / 3)]
    sinks.write_json_array(df, f"{tmp_path}/array", "id")
    with pytest.raises(ValueError):
        sinks.write_json_array(df, f"{tmp_path}/array2", "id", rows=1)
    assert sinks.write_in_parts(df, f"{tmp_path}/parts", "id") == 2
    assert sinks.write_in_parts(df, f"{tmp_path}/parts", "id") == 0
    sinks.append_log(df, f"{tmp_path}/log")
    assert '"t"' not in "".join(r["value"] for r in spark.read.text(f"{tmp_path}/log").collect() if '"id":2' in r["value"])
    built = []
    for _ in range(2):
        stages.cached(spark, f"{tmp_path}/stage", lambda: built.append(1) or df)
    assert built == [1]
    assert spark.range(1).select(sinks.fill_last(F.lit([0, 0, 5, 6]), 0).alias("x")).first()["x"] == [5, 6, 0, 0]


def test_streams(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/in")
    rows = streams.read_stream(spark, f"{tmp_path}/in", "id long")
    train, validation = streams.split_stream(rows, "id", 0.3)
    for x, name in ((train, "s_train"), (validation, "s_val")):
        streams.write_stream(x, f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}").awaitTermination()
    n = [spark.read.parquet(f"{tmp_path}/{name}").count() for name in ("s_train", "s_val")]
    assert sum(n) == 100 and 10 < n[1] < 50
    streams.write_shuffled(rows, f"{tmp_path}/out", f"{tmp_path}/cp", "id").awaitTermination()
    got = [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == list(range(100)) and got != sorted(got)


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    for stub, kind in ((providers.stub_generation, "string"), (providers.stub_embeddings, "array<float>"), (providers.stub_rewards, "double"), (providers.stub_tokens, "array<int>")):
        assert providers.apply(df, stub, "t", "y", kind).where("y IS NULL").count() == 0
    tried = []

    def flaky(texts):
        tried.append(1)
        if len(tried) < 3:
            raise OSError
        return texts

    assert providers.with_retries(flaky, wait=0)(["x"]) == ["x"] and len(tried) == 3
    assert providers.with_fallback(lambda t: [1 / (len(x) - 1) for x in t], -1)(["a", "bb"]) == [-1, 1.0]


def test_reshaping(spark):
    rows = spark.createDataFrame([(7, ["hi", "yo"], [4, 0])], "id int, dialog array<string>, emotion array<int>")
    got = reshape.daily_segments(rows).orderBy("turn").collect()
    assert [(r["UID"], r["SID"], r["EMOTION"]) for r in got] == [("DAILYD-000007-0000", "A", "happiness"), ("DAILYD-000007-0001", "B", "neutral")]


def test_long_series_are_smoothed_in_parts(spark):
    rows = [(g, k, float((k * 37) % 11)) for g, n in (("a", 300), ("b", 7), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(5)
    want = {}
    for g in "abc":
        series = [v for h, _, v in rows if h == g]
        weight, last = 1.8 * (1 / (1 + math.exp(-0.05 * len(series))) - 0.5), series[0]
        for k, v in enumerate(series):
            last = want[g, k] = last * weight + (1 - weight) * v
    for part in (1024, 16, 1):
        got = {(r["g"], r["k"]): r["smoothed"] for r in metrics.smoothed(df, ["g"], "k", "v", part).collect()}
        assert got == {at: pytest.approx(x) for at, x in want.items()}


def test_running_means_of_groups_with_null(spark):
    df = spark.createDataFrame([(g, k, float(k % 5), 1 + k % 3) for g in ("a", None) for k in range(40)], "g string, k long, v double, n int").repartition(3)
    got = {(r["g"], r["k"]): r["running"] for r in metrics.running_mean(df, ["g"], "k", "v", "n").collect()}
    for g in ("a", None):
        top = low = 0.0
        for k in range(40):
            top, low = top + (k % 5) * (1 + k % 3), low + 1 + k % 3
            assert got[g, k] == pytest.approx(top / low)


def test_arrow_folders(spark, tmp_path):
    import pyarrow as pa

    for k in range(2):
        table = pa.table({"id": [k * 2, k * 2 + 1], "x": ["a", None]})
        with pa.OSFile(f"{tmp_path}/{k}.arrow", "wb") as out, (pa.ipc.new_stream if k else pa.ipc.new_file)(out, table.schema) as writer:
            writer.write_table(table)
    got = scan.read_any(spark, str(tmp_path))
    assert got.columns == ["id", "x"] and sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3]


def test_stages_of_preference_training_and_pretraining(spark, tmp_path):
    rows = [{"instruction": "q", "input": "", "output": "o", "good": "g", "bad": "b"}, {"instruction": "q2", "input": "", "output": "o", "good": "g", "bad": None}]
    (tmp_path / "d.json").write_text(json.dumps(rows))
    plain = {"prompt": "instruction", "query": "input", "response": "output"}
    info = {"plain": {"file_name": "d.json", "columns": plain}, "ranked": {"file_name": "d.json", "ranking": True, "columns": {**plain, "chosen": "good", "rejected": "bad"}}}
    (tmp_path / registry.CONFIG).write_text(json.dumps(info))
    assert registry.aligned(spark, ["plain"], str(tmp_path), "pt").count() == 2
    assert registry.aligned(spark, ["ranked"], str(tmp_path), "dpo").count() == 1
    for name, stage in (("plain", "dpo"), ("ranked", "pt"), ("plain", "other")):
        with pytest.raises(ValueError):
            registry.aligned(spark, [name], str(tmp_path), stage)
