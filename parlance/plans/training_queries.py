"""Queries over encoders, batches, packing, alignment, templates, tools and the smaller text and score functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import score, text
from parlance.functions.text import words
from parlance.operators import align, curate, encode, metrics, pack, parse, reshape, templates, tools
from parlance.plans.dialogue_queries import _MESSAGES, _NEXT, _PAIRS, _THREE, CHAT, adjacent, messages, peeled, records, three_parts
from parlance.plans.registry import Tables, query

#: Ids of words that SQL can make too: a word's length, and 10.
_IDS = "list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''), lambda w: length(w) + 10)"
_MINUS = "list_transform(range({n}), lambda k: -100::BIGINT)"
_LIST = "array_to_string({x}, ',')"


def by_length(x: Column) -> Column:
    return F.transform(words(x), lambda w: (F.length(w) + 10).cast("int"))


def listed(*names: str) -> list[Column]:
    return [F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in names]


def _budget_sql(s: str, t: str, cutoff: str) -> str:
    """(source, target) lengths under a cutoff."""
    most = f"CASE WHEN {t} * 2 < {cutoff} THEN {cutoff} WHEN {s} * 2 < {cutoff} THEN {cutoff} - {s} ELSE CAST(floor({cutoff} * ({t}::DOUBLE / greatest({s} + {t}, 1))) AS BIGINT) END"
    return f"{{'s': least(greatest({cutoff} - least({most}, {t}), 0), {s}), 't': least({most}, {t})}}"


_CUTOFF = 96


def _supervised_sql(history: bool = False, on_prompt: bool = False, efficient: bool = False) -> str:
    """Turns of a conversation one after the other, each with what is left of the cutoff."""
    order = "len(pairs) - k" if history else "k + 1"
    source_labels = "src" if on_prompt else f"CASE WHEN b.s > 0 THEN list_concat([2], {_MINUS.format(n='b.s - 1')}) ELSE [] END" if efficient else _MINUS.format(n="b.s")
    target_labels = f"CASE WHEN k > 0 THEN {_MINUS.format(n='b.t')} ELSE tgt END" if history else "tgt"
    joined = ("list_concat(src, tgt, ids)", f"list_concat({source_labels}, {target_labels}, labels)") if history else ("list_concat(ids, src, tgt)", f"list_concat(labels, {source_labels}, {target_labels})")
    end = "[2]" if efficient else "[]::BIGINT[]"
    return f"""WITH RECURSIVE {_MESSAGES}, {_PAIRS},
p AS (SELECT conv_id, len(pairs) AS n, list_transform(range(len(pairs)), lambda k: {{'s': {_IDS.format(x=f'pairs[{order}].u')}, 't': list_concat({_IDS.format(x=f'pairs[{order}].a')}, [2])}}) AS x FROM turns),
steps AS (
  SELECT conv_id, 0 AS k, {int(efficient)}::BIGINT AS used, []::BIGINT[] AS ids, []::BIGINT[] AS labels FROM p
  UNION ALL
  SELECT conv_id, k + 1, CASE WHEN used < {_CUTOFF} THEN used + b.s + b.t ELSE used END, CASE WHEN used < {_CUTOFF} THEN {joined[0]} ELSE ids END, CASE WHEN used < {_CUTOFF} THEN {joined[1]} ELSE labels END
  FROM (SELECT *, x[k + 1].s[1:b.s] AS src, x[k + 1].t[1:b.t] AS tgt FROM (SELECT s.*, p.x, {_budget_sql('len(p.x[s.k + 1].s)', 'len(p.x[s.k + 1].t)', f'({_CUTOFF} - s.used)')} AS b FROM steps s JOIN p USING (conv_id) WHERE s.k < p.n))
)
SELECT conv_id, {_LIST.format(x=f'list_concat(ids, {end})')} AS input_ids, {_LIST.format(x=f'list_concat(labels, {end})')} AS labels, CAST(len(ids) + {int(efficient)} AS INTEGER) AS attended FROM steps JOIN p USING (conv_id) WHERE k = n"""


def supervised(t: Tables, **how) -> DataFrame:
    coded = encode.supervised(encode.pair_tokens(records(t).select("conv_id", "pairs"), "pairs", by_length), _CUTOFF, **how)
    return coded.select("conv_id", *listed("input_ids", "labels"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"))


@query(_supervised_sql())
def supervised_ids(t: Tables) -> DataFrame:
    """Ids and labels of whole conversations under a cutoff that most exceed."""
    return supervised(t)


@query(_supervised_sql(history=True))
def supervised_masked_history(t: Tables) -> DataFrame:
    return supervised(t, mask_history=True)


@query(_supervised_sql(on_prompt=True))
def supervised_on_prompt(t: Tables) -> DataFrame:
    return supervised(t, train_on_prompt=True)


@query(_supervised_sql(efficient=True))
def supervised_efficient_eos(t: Tables) -> DataFrame:
    return supervised(t, efficient_eos=True)


#: Pairs of neighbouring messages: a prompt, an answer, and a worse one without its first word.
_TRIPLES = f"WITH {_NEXT}, x AS (SELECT conv_id, turn, {_IDS.format(x='a')} AS p, list_concat({_IDS.format(x='b')}, [2]) AS c FROM two), triples AS (SELECT *, c[2:] AS r FROM x)"


def triples(t: Tables) -> DataFrame:
    chosen = F.concat(by_length(F.col("b")), F.array(F.lit(2)))
    return adjacent(t).select("conv_id", "turn", by_length(F.col("a")).alias("p"), chosen.alias("c"), F.slice(chosen, F.lit(2), F.size(chosen)).alias("r"))


_PAIRWISE = f"""{_TRIPLES}, y AS (SELECT *, {_budget_sql('len(p)', 'greatest(len(c), len(r))', str(_CUTOFF))} AS b FROM triples),
pairwise AS (SELECT conv_id, turn, list_concat(p[1:b.s], c[1:b.t]) AS ci, list_concat({_MINUS.format(n='len(p[1:b.s])')}, c[1:b.t]) AS cl, list_concat(p[1:b.s], r[1:b.t]) AS ri, list_concat({_MINUS.format(n='len(p[1:b.s])')}, r[1:b.t]) AS rl FROM y)"""


@query(f"{_PAIRWISE} SELECT conv_id, turn, {_LIST.format(x='ci')} AS chosen_input_ids, {_LIST.format(x='cl')} AS chosen_labels, {_LIST.format(x='ri')} AS rejected_input_ids, {_LIST.format(x='rl')} AS rejected_labels FROM pairwise")
def pairwise_ids(t: Tables) -> DataFrame:
    coded = encode.encoder("dpo")(triples(t), "p", "c", "r", _CUTOFF)
    return coded.select("conv_id", "turn", *listed("chosen_input_ids", "chosen_labels", "rejected_input_ids", "rejected_labels"))


_PAD = "list_concat({x}, list_transform(range(longest - len({x})), lambda k: {v}))"


@query(f"""{_PAIRWISE}, rows AS (SELECT conv_id, turn, 0 AS side, ci AS ids, cl AS labels FROM pairwise UNION ALL SELECT conv_id, turn, 1, ri, rl FROM pairwise),
b AS (SELECT *, (max(len(ids)) OVER (PARTITION BY conv_id) + 7) // 8 * 8 AS longest FROM rows)
SELECT conv_id, turn, side, {_LIST.format(x=_PAD.format(x='ids', v='0'))} AS input_ids, {_LIST.format(x=_PAD.format(x='labels', v='-100'))} AS labels, CAST(len(ids) AS INTEGER) AS attended FROM b""")
def pairwise_batches(t: Tables) -> DataFrame:
    """Batches of a conversation: its chosen rows, then its rejected ones, filled up together."""
    coded = encode.pairwise(triples(t), "p", "c", "r", _CUTOFF)
    out = encode.pairwise_batch(coded, "conv_id", "turn")
    return out.select("conv_id", "turn", "side", *listed("input_ids", "labels"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"))


_FEEDBACK = f"""{_TRIPLES}, y AS (SELECT *, {_budget_sql('len(p)', 'len(c)', str(_CUTOFF))} AS b, {_budget_sql('len(p)', 'len(r)', str(_CUTOFF))} AS d FROM triples),
feedback AS (SELECT conv_id, turn, list_concat(p[1:b.s], c[1:b.t]) AS i, list_concat({_MINUS.format(n='b.s')}, c[1:b.t]) AS l, list_concat(p[1:d.s], r[1:d.t]) AS ki, list_concat({_MINUS.format(n='d.s')}, r[1:d.t]) AS kl FROM y)"""


@query(f"""{_FEEDBACK}, b AS (SELECT *, (max(len(i)) OVER w + 7) // 8 * 8 AS ln, (max(len(ki)) OVER w + 7) // 8 * 8 AS kn FROM feedback WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, {_LIST.format(x=_PAD.format(x='i', v='0').replace('longest', 'ln'))} AS input_ids, {_LIST.format(x=_PAD.format(x='l', v='-100').replace('longest', 'ln'))} AS labels,
 {_LIST.format(x=_PAD.format(x='ki', v='0').replace('longest', 'kn'))} AS kl_input_ids, {_LIST.format(x=_PAD.format(x='kl', v='-100').replace('longest', 'kn'))} AS kl_labels FROM b""")
def feedback_batches(t: Tables) -> DataFrame:
    coded = encode.encoder("kto")(triples(t), "p", "c", "r", _CUTOFF)
    return encode.feedback_batch(coded, "conv_id").select("conv_id", "turn", *listed("input_ids", "labels", "kl_input_ids", "kl_labels"))


@query(f"""{_TRIPLES}, y AS (SELECT *, {_budget_sql('len(p)', 'len(c)', str(_CUTOFF))} AS b FROM triples) SELECT conv_id, turn, {_LIST.format(x='p[1:b.s]')} AS input_ids, {_LIST.format(x='c[1:b.t]')} AS labels FROM y""")
def unsupervised_ids(t: Tables) -> DataFrame:
    return encode.encoder("ppo")(triples(t), "p", "c", _CUTOFF).select("conv_id", "turn", *listed("input_ids", "labels"))


@query(f"""WITH d AS (SELECT doc_id, doc_id // 50 AS batch, list_concat({_IDS.format(x="coalesce(text, '')")}, [2]) AS ids FROM documents),
j AS (SELECT batch, flatten(list(ids ORDER BY doc_id)) AS ids FROM d GROUP BY batch)
SELECT batch, CAST(k AS INTEGER) AS block, {_LIST.format(x='ids[k * 512 + 1:k * 512 + 512]')} AS input_ids FROM (SELECT batch, ids, unnest(range(len(ids) // 512)) AS k FROM j)""")
def pretraining_blocks(t: Tables) -> DataFrame:
    """Blocks of 512 ids of each fifty documents end to end."""
    rows = t.documents.select("doc_id", F.floor(F.col("doc_id") / 50).alias("batch"), F.concat(by_length(F.coalesce("text", F.lit(""))), F.array(F.lit(2))).alias("ids"))
    return encode.encoder("pt")(rows, "batch", "doc_id", "ids", 512).select("batch", "block", *listed("input_ids"))


@query(f"""{_TRIPLES}, x2 AS (SELECT conv_id, turn, p[1:20] AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM triples),
j AS (SELECT conv_id, flatten(list(ids ORDER BY k)) AS ids, flatten(list(list_transform(ids, lambda v: k) ORDER BY k)) AS mask FROM x2 GROUP BY conv_id)
SELECT conv_id, {_LIST.format(x="list_concat(ids, list_transform(range(400 - len(ids)), lambda k: 0))")} AS input_ids, {_LIST.format(x="list_concat(mask, list_transform(range(400 - len(ids)), lambda k: 0))")} AS attention_mask,
 {_LIST.format(x="list_concat(ids, list_transform(range(400 - len(ids)), lambda k: -100))")} AS labels FROM j""")
def packed_sequences(t: Tables) -> DataFrame:
    """The first messages of a conversation as one sequence of numbered examples, filled up to 400."""
    rows = triples(t).select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"), F.slice("p", 1, 20).alias("input_ids")).withColumn("labels", F.col("input_ids"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    plan = rows.select("conv_id", "key", F.lit(0).alias("knapsack"), place.alias("place"))
    out = pack.sequences(rows, plan, "conv_id", "key", 400)
    return out.select("conv_id", *listed("input_ids", "attention_mask", "labels"))


@query("""WITH m AS (SELECT conv_id, list_concat(flatten(list(list_transform(range(1 + turn % 3), lambda i: turn + 1) ORDER BY turn)), [0, 0]) AS mask FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(range(1, len(mask) + 1), lambda i: array_to_string(list_transform(range(1, len(mask) + 1), lambda j: CASE WHEN mask[i] <> 0 AND mask[i] = mask[j] AND j <= i THEN 1 ELSE 0 END), '')), '|') AS seen,
 array_to_string(list_filter(range(len(mask)), lambda i: mask[i + 1] <> 0), ',') AS places FROM m""")
def block_masks(t: Tables) -> DataFrame:
    """Which places of a packed sequence see which, and which aren't fill."""
    each = F.sort_array(F.collect_list(F.struct("turn", F.array_repeat((F.col("turn") + 1).cast("int"), (1 + F.col("turn") % 3).cast("int")).alias("ids"))))
    rows = t.conversations.groupBy("conv_id").agg(F.concat(F.flatten(F.transform(each, lambda x: x["ids"])), F.array(F.lit(0), F.lit(0))).alias("mask"))
    seen = F.array_join(F.transform(pack.block_mask(F.col("mask")), lambda r: F.array_join(r.cast("array<string>"), "")), "|")
    return rows.select("conv_id", seen.alias("seen"), F.array_join(pack.attended(F.col("mask")).cast("array<string>"), ",").alias("places"))


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'user=u' || chr(31) || 'assistant=a' || chr(31) ELSE '' END || 'user=' || text || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'more ' || item_id ELSE '' END AS prompt,
 CASE WHEN item_id % 5 = 0 THEN '' ELSE 'assistant=yes ' || item_id END AS response, 'be kind' AS system FROM benchmark""")
def instruction_align(t: Tables) -> DataFrame:
    """Instruction records with history, a query that may be missing, and a response that may be."""
    n = F.col("item_id").cast("string")
    pairs = F.when(F.col("item_id") % 3 == 0, F.array(F.struct(F.lit("u").alias("user"), F.lit("a").alias("assistant"))))
    rows = t.benchmark.select("item_id", F.col("text").alias("instruction"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("more "), n)).alias("input"), F.when(F.col("item_id") % 5 != 0, F.concat(F.lit("yes "), n)).alias("output"), pairs.alias("history"), F.lit("be kind").alias("system"))
    return _flat(align.from_instructions(rows, align.Columns(history="history", system="system"), ["item_id"]), "item_id")


def _flat(aligned: DataFrame, key: str) -> DataFrame:
    said = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\x1f")
    return aligned.select(key, said("_prompt").alias("prompt"), said("_response").alias("response"), F.col("_system").alias("system"))


@query("""SELECT item_id, 'user=' || text AS prompt, CASE WHEN item_id % 2 = 0 THEN 'assistant=r' || chr(31) || 'assistant=' ELSE 'assistant=' || chr(31) || 'assistant=r' END AS response, '' AS system FROM benchmark""")
def feedback_align(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", F.col("text").alias("instruction"), F.lit(None).cast("string").alias("input"), F.lit("r").alias("output"), (F.col("item_id") % 2 == 0).alias("good"))
    aligned = align.from_instructions(rows, align.Columns(kto_tag="good"), ["item_id"])
    return _flat(align.well_formed(aligned, "kto"), "item_id")


@query("""SELECT item_id, 'user=' || text AS prompt, 'assistant=good' || chr(31) || 'assistant=bad' AS response, '' AS system FROM benchmark WHERE item_id % 4 <> 0""")
def ranked_align(t: Tables) -> DataFrame:
    """Chosen and rejected responses, of the rows that preference training can use."""
    align.check_stage("dpo", True)
    rows = t.benchmark.select("item_id", F.col("text").alias("instruction"), F.lit("").alias("input"), F.lit("x").alias("output"), F.lit("good").alias("chosen"), F.when(F.col("item_id") % 4 != 0, "bad").alias("rejected"))
    aligned = align.from_instructions(rows, align.Columns(ranking=True, chosen="chosen", rejected="rejected"), ["item_id"])
    return _flat(align.well_formed(aligned, "dpo"), "item_id")


_STAGE_CHECKS = [(s, ranked, (s in ("rm", "dpo")) == ranked) for s in ("pt", "sft", "rm", "dpo", "kto", "ppo") for ranked in (True, False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {str(r).lower()}, {str(ok).lower()})" for s, r, ok in _STAGE_CHECKS) + ") AS v(stage, ranking, accepted)")
def stage_checks(t: Tables) -> DataFrame:
    """Which stages take ranked data and which take other data."""
    found = []
    for stage, ranking, _ in _STAGE_CHECKS:
        try:
            align.check_stage(stage, ranking)
            found.append((stage, ranking, callable(encode.encoder(stage))))
        except ValueError:
            found.append((stage, ranking, False))
    return t.spark.createDataFrame(found, "stage string, ranking boolean, accepted boolean")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'media/' ELSE '' END || 'a' || (page_id % 30) || '.png,b.png' AS images FROM pages""")
def media_paths(t: Tables) -> DataFrame:
    """Paths that exist get their folder in front; a third of the names exist."""
    rows = t.pages.select("page_id", F.array(F.format_string("a%d.png", F.col("page_id") % 30), F.lit("b.png")).alias("_images"))
    files = t.pages.where("page_id % 3 = 0").select(F.format_string("media/a%d.png", F.col("page_id") % 30).alias("path"))
    return align.with_media_paths(rows, files, "media/").select("page_id", F.array_join("_images", ",").alias("images"))


_CALLS = {
    "default": "'Action: look_up' || chr(10) || 'Action Input: ' || args || chr(10)", "glm4": "'look_up' || chr(10) || args", "llama3": "'{\"name\": \"look_up\", \"parameters\": ' || args || '}'",
    "mistral": "'[{\"name\": \"look_up\", \"arguments\": ' || args || '}]'", "qwen": "'<tool_call>' || chr(10) || '{\"name\": \"look_up\", \"arguments\": ' || args || '}' || chr(10) || '</tool_call>'",
}


@query("WITH a AS (SELECT conv_id, turn, '{\"turn\": ' || turn || ', \"who\": \"' || role || '\"}' AS args FROM conversations) " + " UNION ALL ".join(f"SELECT '{d}' AS dialect, conv_id, turn, {x} AS said, 'look_up' AS name, args AS arguments FROM a" for d, x in _CALLS.items()))
def tool_dialects(t: Tables) -> DataFrame:
    """Tool calls written in each dialect, and read again from what was written."""
    n, who = F.col("turn").cast("string"), F.col("role")
    call = F.concat(F.lit('{"name": "look_up", "arguments": {"turn": '), n, F.lit(', "who": "'), who, F.lit('"}}'))
    out = None
    for dialect in _CALLS:
        rows = t.conversations.select(F.lit(dialect).alias("dialect"), "conv_id", "turn", tools.written(dialect, call).alias("said"))
        rows = rows.withColumn("x", tools.extract(dialect, F.col("said")))
        rows = rows.select("dialect", "conv_id", "turn", "said", F.get("x.calls", F.lit(0))["name"].alias("name"), F.get("x.calls", F.lit(0))["arguments"].alias("arguments"))
        out = rows if out is None else out.unionByName(rows)
    return out


_LISTED = {
    "mistral": "'[AVAILABLE_TOOLS] [{\"type\": \"function\", \"function\": ' || tool || '}][/AVAILABLE_TOOLS]'",
    "default": "'You have access to the following tools:' || chr(10) || '> Tool Name: t' || item_id || chr(10) || 'Tool Description: d' || chr(10) || 'Tool Args:' || chr(10) || '  - q (string, required): what' || chr(10) || chr(10)",
    "llama3": "'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 05 Jan 2024' || chr(10)",
}


@query("""WITH a AS (SELECT item_id, '{"name": "t' || item_id || '", "description": "d", "parameters": {"type": "object", "properties": {"q": {"type": "string", "description": "what"}}, "required": ["q"]}}' AS tool FROM benchmark)
""" + " UNION ALL ".join(f"SELECT '{d}' AS dialect, item_id, {x} AS start FROM a" for d, x in _LISTED.items()))  # fmt: skip
def tool_lists(t: Tables) -> DataFrame:
    """The start of tool prompts, as far as it depends on the tools or the day."""
    tool = F.concat(F.lit('[{"name": "t'), F.col("item_id").cast("string"), F.lit('", "description": "d", "parameters": {"type": "object", "properties": {"q": {"type": "string", "description": "what"}}, "required": ["q"]}}]'))
    out, ends = None, {"mistral": "[/AVAILABLE_TOOLS]", "default": "what\n\n", "llama3": "2024\n"}
    for dialect, end in ends.items():
        said = tools.prompt(dialect, tool, F.lit("05 Jan 2024"))
        rows = t.benchmark.select(F.lit(dialect).alias("dialect"), "item_id", F.concat(F.substring_index(said, end, 1), F.lit(end)).alias("start"))
        out = rows if out is None else out.unionByName(rows)
    return out


_FAMILIES = {"plain": ("Question: ", "\nAnswer: ", "\n"), "inst": ("[INST] ", " [/INST] ", "</s>"), "chatml": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>\n"), "other": ("Question: ", "\nAnswer: ", "\n")}
_lit = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"


@query(f"WITH {_MESSAGES}, {_PAIRS} " + " UNION ALL ".join(f"SELECT '{f}' AS family, conv_id, 'Task.' || chr(10) || array_to_string(list_transform(pairs[:-2], lambda p: {_lit(a)} || p.u || {_lit(b)} || p.a || {_lit(c)}), '') || {_lit(a)} || pairs[-1].u || {_lit(b)} AS prompt FROM turns" for f, (a, b, c) in _FAMILIES.items()))
def family_prompts(t: Tables) -> DataFrame:
    """Prompts that grow with earlier turns, in the tokens of model families; an unknown one is written plainly."""
    rows = records(t).select("conv_id", F.transform("r.history", lambda h: F.struct(h["user"].alias("prompt"), h["assistant"].alias("completion"))).alias("before"), F.col("r.instruction").alias("asked"))
    out = None
    for family in _FAMILIES:
        x = rows.select(F.lit(family).alias("family"), "conv_id", templates.family_prompt(family, "Task.\n", F.col("before"), F.col("asked")).alias("prompt"))
        out = x if out is None else out.unionByName(x)
    return out


@query("""SELECT item_id, 'system=Be brief.' || chr(31) || 'user=Write.' || chr(10) || 'Like this.' || chr(10) || '1. ' || text || ': JOY - CALM; FEAR - KIND' || chr(10) || '2. ' || text || ': ' || item_id || ' - CALM' AS messages,
 'First JOY then ' || item_id || '.' AS system FROM benchmark""")
def generation_prompts(t: Tables) -> DataFrame:
    """Requests for dialogues, and a system prompt with emotions."""
    n, pair = F.col("item_id").cast("string"), lambda h, c: F.struct(h.alias("human"), c.alias("chatbot"))
    emotions = F.array(F.array(pair(F.lit("JOY"), F.lit("CALM")), pair(F.lit("FEAR"), F.lit("KIND"))), F.array(pair(n, F.lit("CALM"))))
    said = templates.generation_request("Be brief.", "Write.", "Like this.", "{k}. {topic}: {turns}", F.col("text"), emotions)
    system = templates.system_prompt(F.array(F.lit("JOY"), n), ("First ", " then ", "."))
    return t.benchmark.select("item_id", F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\x1f").alias("messages"), system.alias("system"))


@query(f"WITH {_MESSAGES} SELECT conv_id, len(said) = 2 AND conv_id % 2 = 0 OR len(said) = 0 AS matching FROM peeled")
def media_placeholders(t: Tables) -> DataFrame:
    """Whether messages have a placeholder for each medium: here one in each, and two media in every second conversation."""
    said = F.transform("said", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("<image>")).alias("content")))
    media = F.when(F.size("said") == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(*[F.lit("x")] * 99))
    return peeled(t).select("conv_id", templates.placeholders_match(said, "<image>", media).alias("matching"))


@query(f"WITH {_MESSAGES}, {_PAIRS} SELECT conv_id, system AS instruction, pairs[-1].u AS prompt, pairs[-1].a AS target, pairs[1].u AS predict_1, pairs[1].a AS predict_2, coalesce(nullif(pairs[-1].u, ''), system, 'none') AS legacy FROM turns")
def aliased_records(t: Tables) -> DataFrame:
    """Records under the names that metric and merge steps expect, with candidates numbered and an older column's name filled in."""
    rows = records(t).select("conv_id", "r.*", F.get("pairs", F.lit(0))["user"].alias("first model"), F.get("pairs", F.lit(0))["assistant"].alias("second model"))
    out = reshape.aliased(rows, {"instruction": "prompt", "output": "target"}, ("input", "history")).withColumnRenamed("system", "instruction")
    out = out.withColumn("given", F.nullif("prompt", F.lit("")))
    return out.select("conv_id", "instruction", "prompt", "target", *reshape.renamed_candidates(["first model", "second model"]), curate.coalesced(["given", "instruction"], "none").alias("legacy"))


_WORD_LENGTHS = "w AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w: length(w)) AS n FROM conversations)"


def lengths(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.transform(words(F.col("text")), lambda w: F.length(w)).alias("n"))


@query(f"""WITH {_WORD_LENGTHS} SELECT conv_id, turn, round(list_avg(list_transform(list_filter(range(1, len(n)), lambda i: i >= 3), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE CAST(n[i + 1] = 0 AS INTEGER) END)), 6) AS accuracy FROM w""")
def token_accuracies(t: Tables) -> DataFrame:
    """Shares of right tokens: every second prediction is right, and the first three labels don't count."""
    pred = F.transform("n", lambda x, i: F.when(i % 2 == 1, F.get("n", i + 1)).otherwise(0))
    rows = lengths(t).select("conv_id", "turn", pred.alias("pred"), F.transform("n", lambda x, i: F.when(i < 3, -100).otherwise(x)).alias("labels"))
    return metrics.token_accuracy(rows).select("conv_id", "turn", F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {_WORD_LENGTHS} SELECT conv_id, turn, round(coalesce(list_sum(list_transform(n[2:len(n) - 1], lambda x: -0.25::DOUBLE * x)), 0), 6) AS total, CAST(greatest(len(n) - 2, 0) AS INTEGER) AS length,
 round(exp(list_avg(n) / 10), 6) AS perplexity FROM w WHERE len(n) > 0""")
def sequence_likelihoods(t: Tables) -> DataFrame:
    """Sums of log-probabilities of the labels that count, and perplexities."""
    logps = F.transform(F.slice("n", F.lit(1), F.size("n") - 1), lambda x: -0.25 * x)
    x = score.masked_logps(logps, F.transform("n", lambda v, i: F.when(i < 2, -100).otherwise(v)))
    # the first label that counts is the third one, which the second log-probability belongs to
    rows = lengths(t).where("size(n) > 0").select("conv_id", "turn", x.alias("x"), score.perplexity(F.transform("n", lambda v: v / 10)).alias("p"))
    return rows.select("conv_id", "turn", F.round("x.sum", 6).alias("total"), F.col("x.length").alias("length"), F.round("p", 6).alias("perplexity"))


@query("SELECT sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) * 3.0::DOUBLE / 50 AS tokens_per_second FROM conversations")
def tokens_per_second(t: Tables) -> DataFrame:
    return metrics.effective_tokens_per_second(lengths(t), "n", 3.0, 50.0)


@query("""SELECT p_partkey, round(CASE WHEN w * h > 262144 THEN sqrt(262144.0::DOUBLE / (w * h)) ELSE 1 END, 9) AS factor, array_to_string(list_transform(range(least(f, 8)), lambda k: CAST(floor(k * (f - 1) / greatest(least(f, 8) - 1, 1)) AS BIGINT)), ',') AS frames
FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 30 + p_partkey % 100 AS h, p_size AS f FROM part)""")
def media_sizes(t: Tables) -> DataFrame:
    """Factors that bring images under a number of pixels, and evenly spaced frames of videos."""
    w, h = F.col("p_size") * 40, F.col("p_size") * 30 + F.col("p_partkey") % 100
    frames = score.frame_places(F.col("p_size"), F.lit(8))
    return t.part.select("p_partkey", F.round(score.resize_factor(w, h, 262_144), 9).alias("factor"), F.array_join(frames.cast("array<string>"), ",").alias("frames"))


_WEIGHTS = [(0.4, 0.4, 0.2), (0.2, 0.6, 0.2), (0.6, 0.2, 0.2), (0.1, 0.1, 0.8)]


@query("WITH w(a, b, c) AS (VALUES " + ", ".join(str(w) for w in _WEIGHTS) + """), s AS (
 SELECT a, b, c, avg(x) AS mean, stddev_pop(x) / avg(x) AS cv FROM (SELECT a, b, c, a * (1 - p_size / 50.0::DOUBLE) + b * p_retailprice / 2000 + c * (p_partkey % 10) / 10.0::DOUBLE AS x FROM part, w) GROUP BY a, b, c)
SELECT CAST(arg_max(a, mean) AS DOUBLE) AS mean_alpha, CAST(arg_max(c, mean) AS DOUBLE) AS mean_gamma, CAST(arg_min(a, cv) AS DOUBLE) AS cv_alpha, CAST(arg_min(c, cv) AS DOUBLE) AS cv_gamma FROM s""")
def sweep_choice(t: Tables) -> DataFrame:
    rows = t.part.select((F.col("p_size") / 50.0).alias("similarity"), (F.col("p_retailprice") / 2000).alias("distinct"), (F.col("p_partkey") % 10 / 10.0).alias("length"))
    best = curate.sweep_choice(curate.weight_sweep(rows, _WEIGHTS))
    return best.select(F.col("by_mean.alpha").alias("mean_alpha"), F.col("by_mean.gamma").alias("mean_gamma"), F.col("by_cv.alpha").alias("cv_alpha"), F.col("by_cv.gamma").alias("cv_gamma"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS worst, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT *, ('0x' || substr(md5(user_id || '|43'), 1, 8))::BIGINT % least(3, n) AS pick FROM r)
SELECT user_id, array_to_string(list(event_id ORDER BY i) FILTER (user_id % 2 = 1 OR worst <> pick), ',') AS candidates, CASE WHEN user_id % 2 = 0 THEN 'changed' END AS modified, CASE WHEN user_id % 2 = 0 THEN 'EMPATHY' ELSE 'None' END AS label
FROM p GROUP BY user_id""")
def negative_candidates(t: Tables) -> DataFrame:
    """Half of the rows lose one of their three worst candidates, the others their modified response."""
    each = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    rows = t.events.groupBy("user_id").agg(each.alias("x")).select("user_id", F.transform("x", lambda x: x["event_id"]).alias("candidates"), F.transform("x", lambda x: x["value"]).alias("scores"), F.lit("changed").alias("modified"), F.lit("EMPATHY").alias("label"))
    out = curate.negatives(rows, "user_id", F.col("user_id") % 2 == 0, "modified", "label")
    return out.select("user_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), "modified", "label")


@query("""SELECT doc_id, options[1 + ('0x' || substr(md5(doc_id || '|44'), 1, 8))::BIGINT % len(options)] AS emotion FROM (
 SELECT doc_id, list_filter(['ANGER', 'FEAR', 'JOY', 'CALM'], lambda e: NOT contains(CASE doc_id % 3 WHEN 0 THEN 'FEAR and JOY' WHEN 1 THEN 'ANGER' ELSE 'none' END, e)) AS options FROM documents)""")
def other_emotions(t: Tables) -> DataFrame:
    current = F.when(F.col("doc_id") % 3 == 0, "FEAR and JOY").when(F.col("doc_id") % 3 == 1, "ANGER").otherwise("none")
    return t.documents.select("doc_id", curate.other_emotion(current, ("ANGER", "FEAR", "JOY", "CALM"), F.col("doc_id")).alias("emotion"))


@query("SELECT conv_id, turn, 'one ' || CASE WHEN turn % 3 = 1 THEN 'new' ELSE text END || ' ' || CASE WHEN turn % 3 = 2 THEN 'new' ELSE role END AS joined FROM (SELECT * FROM conversations) WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, turn, 'new ' || text || ' ' || role FROM conversations WHERE turn % 3 = 0")
def replaced_segments(t: Tables) -> DataFrame:
    segments = F.array(F.lit("one"), F.col("text"), F.col("role"))
    return t.conversations.select("conv_id", "turn", curate.replaced_segment(segments, (F.col("turn") % 3).cast("int"), F.lit("new")).alias("joined"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' ' || text WHEN turn % 3 = 1 THEN ' ' || text ELSE '' END AS first, CASE WHEN turn % 3 <> 1 THEN ' ' || role ELSE '' END AS second FROM conversations")
def two_dialogues(t: Tables) -> DataFrame:
    """Completions with both markers, without the second, or without the first."""
    one, two = F.concat(F.lit("so: Dialogue 1:\n "), F.col("text")), F.concat(F.lit("Dialogue 2:\n "), F.col("role"))
    x = parse.two_dialogues(F.when(F.col("turn") % 3 == 0, F.concat(one, two)).when(F.col("turn") % 3 == 1, one).otherwise(two))
    return t.conversations.select("conv_id", "turn", F.get(x, F.lit(0)).alias("first"), F.get(x, F.lit(1)).alias("second"))


@query(f"""SELECT conv_id, turn, 'so bad.|' || trim(text, chr(32) || chr(10)) || '|why ' || turn || '?' AS utterances, 'ANGER|JOY|NEUTRAL' AS emotions FROM (SELECT conv_id, turn, text, {_THREE} AS response FROM conversations)""")
def split_responses(t: Tables) -> DataFrame:
    x = text.split_response(three_parts(F.col("text")))
    return t.conversations.select("conv_id", "turn", F.array_join(x["utterances"], "|").alias("utterances"), F.array_join(x["emotions"], "|").alias("emotions"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'fear' WHEN turn % 4 = 1 THEN 'joy' WHEN turn % 4 = 2 THEN 'anger' ELSE 'none' END AS emotion FROM conversations")
def completion_emotions(t: Tables) -> DataFrame:
    """Emotions of completions: an option's token, in the order of options, else an emotion word, else none."""
    said = F.when(F.col("turn") % 4 == 0, "I take (B), or (C)").when(F.col("turn") % 4 == 1, "It is pure JOY!").when(F.col("turn") % 4 == 2, "(C) and joy").otherwise(F.concat(F.lit("role "), F.col("role")))
    return t.conversations.select("conv_id", "turn", text.first_emotion(said, {"(A)": "calm", "(B)": "fear", "(C)": "anger"}, ("joy", "fear")).alias("emotion"))


_CLEANED = {"one": "'(B)'", "two": "role", "three": "'the ' || role", "four": "'Q: x? A: (B) because... Q: next'"}


@query(" UNION ALL ".join(f"SELECT '{f}' AS family, conv_id, turn, {x} AS cleaned FROM conversations" for f, x in _CLEANED.items()))
def cleaned_completions(t: Tables) -> DataFrame:
    """Completions after the cleaners of their family; an unknown family's stay as they are, with lines joined."""
    said = {"one": F.lit("Q: x?\nA: (B) because..."), "two": F.concat("role", F.lit("\nmore lines")), "three": F.concat(F.lit("the "), F.col("role"), F.lit("... Q: next")), "four": F.lit("Q: x?\nA: (B) because...\n\nQ: next")}
    steps = {"one": ["after_answer", "to_option"], "two": ["first_line"], "three": ["before_question", "no_trailing_dots"]}
    rows = t.conversations.withColumn("family", F.explode(F.array(*map(F.lit, said))))
    completion = F.coalesce(*[F.when(F.col("family") == f, x) for f, x in said.items()])
    return rows.select("family", "conv_id", "turn", parse.cleaned_completion(completion, F.col("family"), steps).alias("cleaned"))


@query("SELECT conv_id, turn, trim(replace(replace('  ' || text || '   x ', chr(10), ''), '  ', ' '), ' ') AS cleaned FROM conversations")
def cleaned_names(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.clean(F.concat(F.lit("  "), F.col("text"), F.lit("   x "))).alias("cleaned"))


#: (prefix, system, user, assistant) of some formats, written out, where the end of text is </s> and its start <s>.
_FORMATS = {
    "deepseek": ("<s>", "{x}\n\n", "User: {x}\n\nAssistant:", "{x}</s>"),
    "phi": ("", "<|system|>\n{x}<|end|>\n", "<|user|>\n{x}<|end|>\n<|assistant|>\n", "{x}<|end|>\n"),
    "llama3": ("<s>", "<|start_header_id|>system<|end_header_id|>\n\n{x}<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n\n{x}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{x}<|eot_id|>"),
    "exaone": ("", "[|system|]{x}[|endofturn|]\n", "[|user|]{x}\n[|assistant|]", "{x}</s>\n"),
    "granite3": ("", "<|start_of_role|>system<|end_of_role|>{x}<|end_of_text|>\n", "<|start_of_role|>user<|end_of_role|>{x}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", "{x}<|end_of_text|>\n"),
    "cpm3": ("<s>", "<|im_start|>system\n{x}<|im_end|>\n", "<|im_start|>user\n{x}<|im_end|>\n<|im_start|>assistant\n", "{x}<|im_end|>\n"),
    "solar": ("", "### System:\n{x}\n\n", "### User:\n{x}\n\n### Assistant:\n", "{x}</s>"),
    "openchat": ("<s>", "{x}", "GPT4 Correct User: {x}</s>GPT4 Correct Assistant:", "{x}</s>"),
}


def _formatted(format_: str, x: str) -> str:
    return f"replace({_lit(format_)}, '{{x}}', {x})"


@query(f"WITH {_MESSAGES} " + " UNION ALL ".join(
    f"SELECT '{name}' AS template, conv_id, {_lit(p)} || CASE WHEN system = '' THEN '' ELSE {_formatted(s, 'system')} END || array_to_string(list_transform(said, lambda m: CASE WHEN m.role = 'user' THEN {_formatted(u, 'm.content')} ELSE {_formatted(a, 'm.content')} END), '') AS rendered FROM aligned WHERE NOT broken"
    for name, (p, s, u, a) in _FORMATS.items()))
def chat_templates(t: Tables) -> DataFrame:
    """Conversations in eight formats."""
    rows = align.well_formed(align.from_messages(messages(t), CHAT, ["conv_id"]), "sft")
    out = None
    for name in _FORMATS:
        said = templates.render(templates.TEMPLATES[name], F.concat("_prompt", "_response"), F.col("_system"))
        x = rows.select(F.lit(name).alias("template"), "conv_id", F.array_join(said, "").alias("rendered"))
        out = x if out is None else out.unionByName(x)
    return out
