"""Queries over conversations: alignment, reshaping, tags, templates and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.functions.score import budget, distinct_n, length_score, ngrams
from parlance.functions.text import words
from parlance.operators import align, encode, judge, metrics, pack, parse, reshape, templates, tools
from parlance.plans.registry import Tables, query

#: Conversations as message lists, without and with their leading system message.
_MESSAGES = """
all_messages AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS said FROM conversations GROUP BY conv_id
),
peeled AS (
  SELECT conv_id, CASE WHEN said[1].role = 'system' THEN said[1].content ELSE '' END AS system,
         CASE WHEN said[1].role = 'system' THEN said[2:] ELSE said END AS said
  FROM all_messages
),
aligned AS (
  SELECT conv_id, system, said, len(said) = 0 OR len(said) % 2 <> 0 OR len(list_filter(range(1, len(said) + 1), lambda k:
    said[k].role <> CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 AS broken FROM peeled
)
"""


def messages(t: Tables) -> DataFrame:
    return reshape.conversations(t.conversations)


def peeled(t: Tables) -> DataFrame:
    return messages(t).withColumn("said", reshape.peeled(F.col("messages")))


CHAT = align.Columns(messages="messages", tags=align.Tags(role="role", content="content", user="user", assistant="assistant", system="system"))


def flat(x: str):
    return F.array_join(F.transform(x, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\x1f")


@query(f"""WITH {_MESSAGES}
SELECT conv_id, CASE WHEN broken THEN '' ELSE array_to_string(list_transform(said[:-2], lambda m: m.role || '=' || m.content), chr(31)) END AS prompt,
       CASE WHEN broken THEN '' ELSE said[-1].role || '=' || said[-1].content END AS response, system FROM aligned""")
def sharegpt_align(t: Tables) -> DataFrame:
    return align.from_messages(messages(t), CHAT, ["conv_id"]).select("conv_id", flat("_prompt").alias("prompt"), flat("_response").alias("response"), F.col("_system").alias("system"))


@query(f"WITH {_MESSAGES} SELECT conv_id, CAST(len(said) - 1 AS INTEGER) AS n_prompt FROM aligned WHERE NOT broken")
def sharegpt_supervised(t: Tables) -> DataFrame:
    rows = align.well_formed(align.from_messages(messages(t), CHAT, ["conv_id"]), "sft")
    return rows.select("conv_id", F.size("_prompt").alias("n_prompt"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id) = 4")
def four_turn_dialogues(t: Tables) -> DataFrame:
    return reshape.with_turns(t.conversations, "conv_id", 4)


_PAIRS = """turns AS (SELECT conv_id, system, list_transform(range(0, len(said) // 2), lambda k: {'u': said[2 * k + 1].content, 'a': said[2 * k + 2].content}) AS pairs FROM peeled WHERE len(said) >= 2)"""


def records(t: Tables) -> DataFrame:
    system = F.when(F.get("messages", F.lit(0))["role"] == "system", F.get("messages", F.lit(0))["content"]).otherwise("")
    rows = peeled(t).withColumn("pairs", reshape.turn_pairs(F.col("said"))).where("size(pairs) > 0")
    return rows.select("conv_id", "pairs", system.alias("system"), reshape.dialogue_record(F.col("pairs"), system).alias("r"))


@query(f"""WITH {_MESSAGES}, {_PAIRS}
SELECT conv_id, system, array_to_string(list_transform(pairs[:-2], lambda p: p.u || chr(30) || p.a), chr(31)) AS history, pairs[-1].u AS instruction, pairs[-1].a AS output FROM turns""")
def history_record(t: Tables) -> DataFrame:
    history = F.array_join(F.transform("r.history", lambda h: F.concat(h["user"], F.lit("\x1e"), h["assistant"])), "\x1f")
    return records(t).select("conv_id", "r.system", history.alias("history"), "r.instruction", "r.output")


@query(f"""WITH {_MESSAGES}, {_PAIRS}
SELECT conv_id, 'system=' || system || chr(31) || array_to_string(list_concat(flatten(list_transform(pairs[:-2], lambda p: ['human=' || p.u, 'gpt=' || p.a])), ['human=' || pairs[-1].u]), chr(31)) AS conversation,
       pairs[-1].a AS chosen FROM turns""")
def chat_export(t: Tables) -> DataFrame:
    said = reshape.exported(F.col("system"), F.col("r.history"), F.col("r.instruction"))
    return records(t).select("conv_id", F.array_join(F.transform(said, lambda m: F.concat(m["from"], F.lit("="), m["value"])), "\x1f").alias("conversation"), F.col("r.output").alias("chosen"))


@query("""SELECT printf('DAILYD-%06d-%04d', conv_id, turn) AS uid, printf('DAILYD-%06d', conv_id) AS did, CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END AS sid, text AS seg,
CASE WHEN turn % 7 = 0 THEN 'neutral' WHEN turn % 7 = 1 THEN 'anger' WHEN turn % 7 = 2 THEN 'disgust' WHEN turn % 7 = 3 THEN 'fear' WHEN turn % 7 = 4 THEN 'happiness' WHEN turn % 7 = 5 THEN 'sadness' ELSE 'surprise' END AS emotion
FROM conversations""")
def speaker_segments(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    dialogues = rows.select("id", F.col("x.text").alias("dialog"), F.transform("x", lambda x: (x["turn"] % 7).cast("int")).alias("emotion"))
    out = reshape.daily_segments(dialogues)
    return out.select(F.col("UID").alias("uid"), F.col("DID").alias("did"), F.col("SID").alias("sid"), F.col("SEG").alias("seg"), F.col("EMOTION").alias("emotion"))


@query("""SELECT conv_id, turn, text AS prompt, '(' || 'e' || (turn % 3) || ') ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn) || ' (x) ' || role || ' (NEUTRAL) ' || turn AS completion
FROM conversations QUALIFY role = 'user'""")
def user_turns_completion(t: Tables) -> DataFrame:
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "USER").otherwise("CHATBOT").alias("SID"), F.col("text").alias("SEG"), F.concat(F.lit("e"), (F.col("turn") % 3).cast("string")).alias("EMOTION_RESPONSE_1"), after.alias("RESPONSE_1"),
        F.lit("x").alias("EMOTION_RESPONSE_2"), F.col("role").alias("RESPONSE_2"), F.lit("NEUTRAL").alias("EMOTION_RESPONSE_3"), F.col("turn").cast("string").alias("RESPONSE_3"),
    )
    out = reshape.user_turns(rows).withColumn("COMPLETION", F.when(F.col("RESPONSE_1").isNotNull(), F.col("COMPLETION")))
    return out.select("conv_id", "turn", F.col("PROMPT").alias("prompt"), F.col("COMPLETION").alias("completion"))


@query(f"""WITH {_MESSAGES}
SELECT conv_id, k, CASE WHEN k = 1 THEN said[1].content ELSE said[k].content END AS picked FROM (SELECT conv_id, said, CAST(1 + conv_id % 10 AS INTEGER) AS k FROM peeled WHERE len(said) >= 1)""")
def pick_response(t: Tables) -> DataFrame:
    rows = peeled(t).where("size(said) >= 1").withColumn("k", (1 + F.col("conv_id") % 10).cast("int"))
    texts = F.transform("said", lambda m: m["content"])
    return rows.select("conv_id", "k", judge.pick(F.get(texts, F.lit(0)), F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), F.col("k")).alias("picked"))


#: Words as white space separates them, and pooled n-grams of two texts.
_WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
_NEXT = "pair AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), two AS (SELECT * FROM pair WHERE b IS NOT NULL)"


def _gram_sql(n: int) -> str:
    grams = f"CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], chr(31))) ELSE [] END"
    return grams


def adjacent(t: Tables) -> DataFrame:
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("a"), after.alias("b")).where("b IS NOT NULL")


def _distinct_sql(n: int) -> str:
    return f"""WITH {_NEXT}, w AS (
  SELECT conv_id, turn, {_WORDS.format(x='a')} AS wa, {_WORDS.format(x='b')} AS wb FROM two),
g AS (SELECT conv_id, turn, list_concat({_gram_sql(n).replace('(w)', '(wa)').replace('w[i', 'wa[i')}, {_gram_sql(n).replace('(w)', '(wb)').replace('w[i', 'wb[i')}) AS g FROM w)
SELECT conv_id, turn, CASE WHEN len(g) > 0 THEN len(list_distinct(g))::DOUBLE / len(g) ELSE 0::DOUBLE END AS distinct_{n} FROM g"""


@query(_distinct_sql(2))
def distinct_2(t: Tables) -> DataFrame:
    return adjacent(t).select("conv_id", "turn", distinct_n([F.col("a"), F.col("b")], 2).alias("distinct_2"))


@query(_distinct_sql(3))
def distinct_3(t: Tables) -> DataFrame:
    return adjacent(t).select("conv_id", "turn", distinct_n([F.col("a"), F.col("b")], 3).alias("distinct_3"))


@query(f"""WITH {_NEXT} SELECT conv_id, turn, round(greatest(0, exp(-power(abs((len({_WORDS.format(x='a')}) + len({_WORDS.format(x='b')})) / 2 - len({_WORDS.format(x='b')})) / 8, 3))), 6) AS score FROM two""")
def length_scores(t: Tables) -> DataFrame:
    a, b = F.size(words(F.col("a"))), F.size(words(F.col("b")))
    return adjacent(t).select("conv_id", "turn", F.round(length_score(b.cast("double"), (a + b) / 2), 6).alias("score"))


@query(f"""WITH {_NEXT}, w AS (SELECT conv_id, turn, {_WORDS.format(x='a')} AS wa, {_WORDS.format(x='b')} AS wb FROM two),
g AS (SELECT conv_id, turn, list_distinct(wa) AS a1, list_distinct(wb) AS b1, list_distinct({_gram_sql(2).replace('(w)', '(wa)').replace('w[i', 'wa[i')}) AS a2, list_distinct({_gram_sql(2).replace('(w)', '(wb)').replace('w[i', 'wb[i')}) AS b2 FROM w)
SELECT conv_id, turn,
  round_even(100 * coalesce(2::DOUBLE * len(list_intersect(a1, b1)) / nullif(len(a1) + len(b1), 0), 0), 4) AS rouge_1,
  round_even(100 * coalesce(2::DOUBLE * len(list_intersect(a2, b2)) / nullif(len(a2) + len(b2), 0), 0), 4) AS rouge_2 FROM g""")
def rouge_n(t: Tables) -> DataFrame:
    a, b = words(F.col("a")), words(F.col("b"))
    two = lambda w: ngrams(w, 2)
    return adjacent(t).select("conv_id", "turn", metrics.rouge_n(a, b, lambda w: w).alias("rouge_1"), metrics.rouge_n(a, b, two).alias("rouge_2"))


@query()
def rouge_l_bleu(t: Tables) -> DataFrame:
    return adjacent(t).select("conv_id", "turn", metrics.rouge_l("a", "b").alias("rouge_l"), metrics.bleu_4("a", "b").alias("bleu_4"))


#: Texts with tags: three, two or no parts, by turn.
_BARE = "replace(replace(text, '(', ''), ')', '')"
_THREE = "'(ANGER) so bad. (JOY) ' || text || ' (NEUTRAL) why ' || turn || '?'"
_TWO = f"'(FEAR) oh no (CALM) ' || {_BARE} || '. Is it ' || turn || '?'"
_TAGGED = f"""tagged AS (
  SELECT conv_id, turn, '(' || upper(role) || ') ' || text AS prompt, CASE turn % 3 WHEN 0 THEN {_THREE} WHEN 1 THEN {_TWO} ELSE text END AS response
  FROM conversations)"""


def three_parts(text: Column) -> Column:
    return F.concat(F.lit("(ANGER) so bad. (JOY) "), text, F.lit(" (NEUTRAL) why "), F.col("turn").cast("string"), F.lit("?"))


def two_parts(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit("("), F.lit("")), F.lit(")"), F.lit(""))
    return F.concat(F.lit("(FEAR) oh no (CALM) "), bare, F.lit(". Is it "), F.col("turn").cast("string"), F.lit("?"))


def tagged(t: Tables) -> DataFrame:
    """Tagged prompts and responses."""
    text = F.col("text")
    response = F.when(F.col("turn") % 3 == 0, three_parts(text)).when(F.col("turn") % 3 == 1, two_parts(text)).otherwise(text)
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("("), F.upper("role"), F.lit(") "), text).alias("prompt"), response.alias("response"))


@query(f"""WITH {_TAGGED} SELECT conv_id, turn, array_to_string(list_concat(regexp_extract_all(response, '\\(.*?\\)'), ['', '', ''])[1:3], '|') AS tags FROM tagged""")
def three_tags(t: Tables) -> DataFrame:
    return tagged(t).select("conv_id", "turn", F.array_join(X.three_tags(F.col("response")), "|").alias("tags"))


@query(f"""WITH {_TAGGED}, x AS (SELECT conv_id, list_concat(regexp_extract_all(response, '\\(.*?\\)'), ['', '', ''])[1:3] AS tags, regexp_extract(prompt, '\\((.*?)\\)', 1) AS who FROM tagged)
SELECT conv_id, count(*) AS total_examples,
 CAST(sum(CAST(tags[1] = '(ANGER)' AS INTEGER)) AS BIGINT) AS user_correct, round_even(100.0::DOUBLE * sum(CAST(tags[1] = '(ANGER)' AS INTEGER)) / count(*), 2) AS user_percentage,
 CAST(sum(CAST(tags[2] = '(CALM)' AS INTEGER)) AS BIGINT) AS chatbot_correct, round_even(100.0::DOUBLE * sum(CAST(tags[2] = '(CALM)' AS INTEGER)) / count(*), 2) AS chatbot_percentage,
 CAST(sum(CAST(tags[3] = '(NEUTRAL)' AS INTEGER)) AS BIGINT) AS neutral_correct, round_even(100.0::DOUBLE * sum(CAST(tags[3] = '(NEUTRAL)' AS INTEGER)) / count(*), 2) AS neutral_percentage
FROM x GROUP BY conv_id""")
def tag_agreement(t: Tables) -> DataFrame:
    tags = X.three_tags(F.col("response"))
    return metrics.agreement(tagged(t), F.get(tags, F.lit(0)) == "(ANGER)", F.get(tags, F.lit(1)) == "(CALM)", F.get(tags, F.lit(2)) == "(NEUTRAL)", ["conv_id"])


@query(f"WITH {_TAGGED} SELECT conv_id, round(avg(len(regexp_extract_all(response, '\\(.*?\\)'))), 6) AS mean_tags FROM tagged GROUP BY conv_id")
def mean_tags(t: Tables) -> DataFrame:
    return tagged(t).groupBy("conv_id").agg(F.round(metrics.mean_tags(tagged(t), "response"), 6).alias("mean_tags"))


@query(f"""WITH m AS (SELECT conv_id, turn, {_THREE} AS response FROM conversations)
SELECT conv_id, turn, '(EMPATHY) so bad. (JOY) ' || trim(regexp_extract(response, '\\(JOY\\)((?s:.*)) \\(NEUTRAL\\)', 1), chr(32) || chr(10)) || ' (QUESTION) why ' || turn || '?' AS rewritten,
  '(USER) so bad. (JOY) ' || trim(regexp_extract(response, '\\(JOY\\)((?s:.*)) \\(NEUTRAL\\)', 1), chr(32) || chr(10)) || ' (NEUTRAL) why ' || turn || '?' AS restored FROM m""")
def role_tag_rewrite(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("rewritten", X.role_tags(three_parts(F.col("text"))))
    return rows.select("conv_id", "turn", "rewritten", X.restore_tags(F.col("rewritten"), F.lit("(USER) hello")).alias("restored"))


@query(f"""WITH m AS (SELECT conv_id, turn, trim({_BARE} || '. Is it ' || turn || '?', chr(32) || chr(10)) AS tail FROM conversations)
SELECT conv_id, turn, trim(replace('(EMPATHY) oh no (CALM) ' || trim(regexp_extract(tail, '^((?s:.*)[.!?]) ((?s:.*))$', 1), chr(32) || chr(10)) || ' (QUESTION) ' || trim(regexp_extract(tail, '^((?s:.*)[.!?]) ((?s:.*))$', 2), chr(32) || chr(10)), '  ', ' '), chr(32) || chr(10)) AS rewritten FROM m""")
def role_tag_repair(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.role_tags(two_parts(F.col("text"))).alias("rewritten"))


@query(f"WITH {_TAGGED} SELECT conv_id, turn, regexp_extract(prompt, '\\(([^)]*)\\)', 1) AS human, CASE turn % 3 WHEN 0 THEN 'JOY' WHEN 1 THEN 'CALM' END AS chatbot FROM tagged")
def pair_emotions(t: Tables) -> DataFrame:
    e = X.pair_emotions(F.col("prompt"), F.when(F.col("turn") % 3 < 2, F.col("response")).otherwise("none"))
    return tagged(t).select("conv_id", "turn", e["human"].alias("human"), e["chatbot"].alias("chatbot"))


#: Transcripts with marks, of conversations of two messages and more.
_HH = f"""WITH {_MESSAGES}, {_PAIRS}"""


@query(f"""{_HH} SELECT conv_id, array_to_string(list_transform(pairs[:-2], lambda p: p.u || chr(30) || p.a), chr(31)) AS history, pairs[-1].u AS instruction, pairs[-1].a AS chosen, 'no' AS rejected FROM turns""")
def hh_parse(t: Tables) -> DataFrame:
    said = F.array_join(F.transform("pairs", lambda p: F.concat(F.lit("\n\nHuman: "), p["user"], F.lit("\n\nAssistant: "), p["assistant"])), "")
    start = F.array_join(F.transform(F.slice("pairs", F.lit(1), F.size("pairs") - 1), lambda p: F.concat(F.lit("\n\nHuman: "), p["user"], F.lit("\n\nAssistant: "), p["assistant"])), "")
    other = F.concat(start, F.lit("\n\nHuman: "), F.element_at("pairs", -1)["user"], F.lit("\n\nAssistant: no"))
    x = parse.preference_text(said, other)
    history = F.array_join(F.transform(x["history"], lambda h: F.concat(h["user"], F.lit("\x1e"), h["assistant"])), "\x1f")
    return records(t).select("conv_id", history.alias("history"), x["instruction"].alias("instruction"), x["chosen"].alias("chosen"), x["rejected"].alias("rejected"))


@query(f"WITH {_MESSAGES} SELECT conv_id, CAST(len(said) - len(said) % 2 AS INTEGER) AS n, array_to_string(list_transform(range(1, len(said) - len(said) % 2 + 1), lambda k: CASE WHEN k % 2 = 1 THEN 'human=' ELSE 'gpt=' END || said[k].content), chr(31)) AS conversation FROM peeled WHERE len(said) >= 2")
def ultra_chat(t: Tables) -> DataFrame:
    rows = peeled(t).withColumn("x", parse.alternating(F.transform("said", lambda m: m["content"]))).where("x IS NOT NULL")
    return rows.select("conv_id", F.size("x").alias("n"), F.array_join(F.transform("x", lambda m: F.concat(m["from"], F.lit("="), m["value"])), "\x1f").alias("conversation"))


_BUDGET = f"""lens AS (SELECT conv_id, turn, len({_WORDS.format(x='a')}) AS s, len({_WORDS.format(x='b')}) AS t FROM two)"""


@query(f"""WITH {_NEXT}, {_BUDGET}, m AS (SELECT *, CASE WHEN t * 2 < 128 THEN 128 WHEN s * 2 < 128 THEN 128 - s ELSE CAST(floor(128 * (t::DOUBLE / (s + t))) AS INTEGER) END AS most FROM lens)
SELECT conv_id, turn, CAST(least(greatest(128 - least(most, t), 0), s) AS INTEGER) AS source_len, CAST(least(most, t) AS INTEGER) AS target_len FROM m""")
def seqlen_budget(t: Tables) -> DataFrame:
    b = budget(F.size(words(F.col("a"))), F.size(words(F.col("b"))), 128)
    return adjacent(t).select("conv_id", "turn", b["source"].alias("source_len"), b["target"].alias("target_len"))


@query(f"""WITH {_MESSAGES}, {_PAIRS}, lens AS (
  SELECT conv_id, list_transform(pairs, lambda p: len({_WORDS.format(x='p.u')})) AS us, list_transform(pairs, lambda p: len({_WORDS.format(x='p.a')}) + 1) AS al FROM turns)
SELECT conv_id, CAST(list_sum(us) + list_sum(al) AS INTEGER) AS n_ids, CAST(list_sum(al) AS INTEGER) AS n_labels FROM lens WHERE list_sum(us) + list_sum(al) < 100000""")
def label_mask(t: Tables) -> DataFrame:
    coded = encode.supervised(encode.pair_tokens(records(t).select("conv_id", "pairs"), "pairs"), cutoff=1_000_000)
    return coded.select("conv_id", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda y: y != -100)).alias("n_labels"))


@query(f"""WITH {_MESSAGES}, {_PAIRS}, n AS (
  SELECT conv_id, CAST(list_sum(list_transform(pairs, lambda p: len({_WORDS.format(x='p.u')}) + len({_WORDS.format(x='p.a')}) + 1)) AS INTEGER) AS n FROM turns),
b AS (SELECT conv_id, n, conv_id // 4 AS batch, max(n) OVER (PARTITION BY conv_id // 4) AS longest FROM n)
SELECT conv_id, batch, CAST((longest + 7) // 8 * 8 AS INTEGER) AS padded, n AS attended FROM b""")
def pad_batch(t: Tables) -> DataFrame:
    coded = encode.supervised(encode.pair_tokens(records(t).select("conv_id", "pairs"), "pairs"), cutoff=1_000_000)
    out = encode.padded(coded.withColumn("batch", F.floor(F.col("conv_id") / 4)), "batch", 8)
    return out.select("conv_id", "batch", F.size("input_ids").alias("padded"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"))


@query(f"""WITH {_MESSAGES}, r AS (SELECT conv_id, said[-1].content AS answer, row_number() OVER (PARTITION BY conv_id // 8 ORDER BY conv_id) AS k, count(*) OVER (PARTITION BY conv_id // 8) AS n FROM peeled WHERE len(said) > 0)
SELECT a.conv_id, b.conv_id AS kl_conv_id, b.answer AS kl_answer FROM r a JOIN r b ON a.conv_id // 8 = b.conv_id // 8 AND b.k = a.n + 1 - a.k""")
def kl_mismatch(t: Tables) -> DataFrame:
    rows = peeled(t).where("size(said) > 0").select("conv_id", F.element_at("said", -1)["content"].alias("answer"), F.floor(F.col("conv_id") / 8).alias("batch"))
    return encode.mismatched(rows, "batch", "conv_id", ["conv_id", "answer"]).select("conv_id", "kl_conv_id", "kl_answer")


@query(f"""WITH {_MESSAGES}, e AS (SELECT conv_id, system, said, list_transform(range(1, len(said) + 1), lambda k: CASE WHEN said[k].role = 'user' THEN '<|im_start|>user' || chr(10) || said[k].content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE said[k].content || '<|im_end|>' || chr(10) END) AS parts FROM aligned WHERE NOT broken)
SELECT conv_id, '<|im_start|>system' || chr(10) || CASE WHEN system = '' THEN 'You are a helpful assistant.' ELSE system END || '<|im_end|>' || chr(10) || array_to_string(parts, '') AS rendered FROM e""")
def chat_template(t: Tables) -> DataFrame:
    rows = align.well_formed(align.from_messages(messages(t), CHAT, ["conv_id"]), "sft")
    said = F.concat("_prompt", "_response")
    return rows.select("conv_id", F.array_join(templates.render(templates.TEMPLATES["qwen"], said, F.col("_system")), "").alias("rendered"))


@query("""SELECT item_id, 'The following are multiple choice questions (with answers) about prose.' || chr(10) || chr(10) || text || chr(10) || 'A. ' || left(text, 10) || chr(10) || 'B. ' || right(text, 10) || chr(10) || 'Answer:' AS prompt,
 CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS response FROM benchmark""")
def mcq_template(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", F.col("text").alias("question"), F.left("text", F.lit(10)).alias("A"), F.right("text", F.lit(10)).alias("B"), F.lit(None).cast("string").alias("C"), F.lit(None).cast("string").alias("D"), F.when(F.col("item_id") % 2 == 0, "A").otherwise("B").alias("answer"))
    m = templates.mcq_messages("en", F.array().cast(f"array<{templates.EXAMPLE}>"), templates.example(), F.lit("prose"))
    return rows.withColumn("m", m).select("item_id", F.get("m", F.lit(0))["content"].alias("prompt"), F.get("m", F.lit(1))["content"].alias("response"))


@query("""SELECT conv_id, turn, 'tool_' || turn AS name, '{"k": ' || turn || '}' AS arguments FROM conversations""")
def tool_extract(t: Tables) -> DataFrame:
    said = F.concat(F.col("text"), F.lit("\nAction: tool_"), F.col("turn").cast("string"), F.lit('\nAction Input: {"k": '), F.col("turn").cast("string"), F.lit("}\n"))
    rows = t.conversations.select("conv_id", "turn", tools.extract("default", said).alias("x"))
    return rows.select("conv_id", "turn", F.get("x.calls", F.lit(0))["name"].alias("name"), F.get("x.calls", F.lit(0))["arguments"].alias("arguments"))


@query("""SELECT event_id, CAST(event_id % 9 + 1 AS INTEGER) AS empathy, CAST(user_id % 9 + 1 AS INTEGER) AS emotion, CAST(floor(value) % 9 + 1 AS INTEGER) AS question FROM events""")
def rating_parse(t: Tables) -> DataFrame:
    n = [(F.col("event_id") % 9 + 1).cast("int"), (F.col("user_id") % 9 + 1).cast("int"), (F.floor("value") % 9 + 1).cast("int")]
    line = F.concat(F.lit("A1: Empathy: "), n[0].cast("string"), F.lit(",Chatbot Emotion: "), n[1].cast("string"), F.lit(" ,Question: "), n[2].cast("string"), F.lit("\n\n"))
    triple = F.get(X.ratings(line), F.lit(0))
    return t.events.select("event_id", *[F.get(triple, F.lit(k)).alias(name) for k, name in enumerate(("empathy", "emotion", "question"))])


@query()
def knapsack_pack(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.size(words(F.coalesce("text", F.lit("")))).alias("length"), F.floor(F.col("doc_id") / 100).alias("batch"))
    return pack.packed(rows, "batch", "doc_id", "length", 4096)


@query("""WITH m AS (SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS id, CAST(1 + length(text) % 5 AS INTEGER) AS n FROM conversations)
SELECT conv_id, id, n AS length, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY id) AS INTEGER) AS cumulative FROM m""")
def seq_boundaries(t: Tables) -> DataFrame:
    each = F.sort_array(F.collect_list(F.struct("turn", (1 + F.length("text") % 5).alias("n"))))
    rows = t.conversations.groupBy("conv_id").agg(each.alias("x"))
    mask = F.concat(F.flatten(F.transform("x", lambda x, k: F.array_repeat((k + 1).cast("int"), x["n"]))), F.array(F.lit(0), F.lit(0)))
    return pack.boundaries(rows.select("conv_id", mask.alias("mask")), "conv_id", "mask")
