"""Whole chains: generation to segments, ratings to preference records, and files to training tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import providers
from parlance.functions.text import ratings
from parlance.operators import judge, parse, reshape, templates
from parlance.plans.dialogue_queries import _MESSAGES, _PAIRS
from parlance.plans.registry import Tables, query


@query(r"""WITH n AS (SELECT role, regexp_replace(text, '[\r\n]+', ' ', 'g') AS line, 3 * (row_number() OVER (ORDER BY conv_id * 100 + turn) - 1) AS first FROM conversations),
d AS (SELECT *, first + unnest([0, 1, 2]) AS number FROM n)
SELECT printf('CHATGPT-%06d-0000', number) AS "UID", printf('RLAIFE-%06d', number) AS "DIALOGUE_ID", 'USER' AS "SID", ltrim(line) AS "SEG", 'JOY' AS "EMOTION" FROM d
UNION ALL SELECT printf('CHATGPT-%06d-0001', number), printf('RLAIFE-%06d', number), 'CHATBOT', role || ' so it is why?', 'CALM|FEAR|NEUTRAL' FROM d""")
def parse_generations(t: Tables) -> DataFrame:
    """Free texts with three marked dialogues of one turn each, made of conversations, parsed to segments."""
    one_line = F.regexp_replace("text", r"[\r\n]+", " ")
    six = lambda k: F.concat(F.lit(f"Dialogue {k}:\n(JOY) "), one_line, F.lit("\n(CALM) "), F.col("role"), F.lit("\n(FEAR) x\nStep 2: because\nStep 3: so it is\n(NEUTRAL) why?\n"))
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.concat(six(1), six(2), six(3)).alias("completion"))
    out = parse.segments(rows, "completion", "pos")
    return out.select("UID", "DIALOGUE_ID", "SID", "SEG", F.array_join("EMOTION", "|").alias("EMOTION"))


def rated(t: Tables) -> DataFrame:
    """Each message that was answered, with ten answers made of its own, and the prompt that asks to rate these."""
    pairs = reshape.turn_pairs(reshape.peeled(F.col("messages")))
    rows = reshape.conversations(t.conversations).select("conv_id", F.posexplode(pairs).alias("k", "pair"))
    rows = rows.select(F.format_string("RLAIFE-%08d", F.col("conv_id") * 100 + F.col("k")).alias("dialogue_id"), "pair")
    first = F.col("pair")
    answers = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat(F.lit("(EMPATHY) yes (JOY) "), first["assistant"], F.lit(" "), k.cast("string"), F.lit(" (QUESTION) and?")))
    rows = rows.select("dialogue_id", F.concat(F.lit("(FEAR) "), F.replace(first["user"], F.lit("\n"), F.lit(" "))).alias("prompt"), F.transform(answers, lambda a: F.replace(a, F.lit("\n"), F.lit(" "))).alias("answers"))
    history = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(F.lit("(FEAR) a").alias("user"), F.lit("(EMPATHY) b (JOY) c (QUESTION) d?").alias("assistant")))
    return rows.withColumn("rating_prompt", templates.rating_prompt(history, F.col("prompt"), F.col("answers"), F.lit("FEAR"), F.lit("JOY")))


@query(f"""WITH {_MESSAGES}, {_PAIRS}, p AS (SELECT conv_id * 100 + k AS id, replace(pairs[k + 1].u, chr(10), ' ') AS u, replace(pairs[k + 1].a, chr(10), ' ') AS a FROM (SELECT conv_id, pairs, unnest(range(len(pairs))) AS k FROM turns))
SELECT printf('RLAIFE-%08d', id) AS dialogue_id, trim('(FEAR) ' || u) AS prompt, 10 AS n, '(FEAR) yes (JOY) ' || a || ' 10 (NEUTRAL) and?' AS last FROM p""")
def rating_prompt_round_trip(t: Tables) -> DataFrame:
    """Rendered rating prompts, parsed again to prompt and answers."""
    x = parse.rating_prompt(F.col("rating_prompt"))
    return rated(t).select("dialogue_id", x["prompt"].alias("prompt"), F.size(x["responses"]).alias("n"), F.try_element_at(x["responses"], F.lit(10)).alias("last"))


@query()
def preference_chain(t: Tables) -> DataFrame:
    """Ratings of two judges to chosen and rejected texts with preference ids."""
    rows = rated(t)
    one = [providers.apply(rows.withColumn("asked", F.concat("rating_prompt", F.lit(f" judge {j}"))), providers.stub_ratings, "asked", "said").withColumn("judge", F.lit(str(j))) for j in (1, 2)]
    each = one[0].unionByName(one[1]).select("dialogue_id", "judge", F.posexplode(ratings(F.col("said"))).alias("k", "triple"))
    each = each.select("dialogue_id", "judge", (F.col("k") + 1).alias("response"), F.posexplode("triple").alias("criterion", "rate"))
    scored = judge.rescaled(each, ["judge", "criterion"]).groupBy("dialogue_id", "judge", "response").agg(F.sum("rescaled").alias("rescaled"))
    pairs = judge.preference_pairs(judge.rank_arrays(judge.overall(scored)), ["dialogue_id"])
    texts = pairs.join(rows.select("dialogue_id", "answers"), "dialogue_id")
    of = lambda c: F.get("answers", F.col(c) - 1)
    named = judge.preference_ids(judge.drop_equal(texts.withColumns({"winner_response": of("winner"), "loser_response": of("loser")})))
    return named.select("preference_id", "dialogue_id", "winner", "loser")
