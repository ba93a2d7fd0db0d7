"""Queries of the preference chain over events, ten responses to a dialogue and two judges for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.score import dpo_loss, expression_score, orpo_loss, pair_loss, simpo_loss
from parlance.functions.text import numbered
from parlance.operators import judge, metrics
from parlance.plans.registry import Tables, query

#: Events as ratings: judge 'value' rates by value, judge 'props' by the number in props; ten events are a dialogue.
_RATES = """
events_rates AS (
  SELECT event_id // 10 AS dialogue_id, CAST(event_id % 10 + 1 AS INTEGER) AS response, event_type, 'value' AS judge, value AS rate FROM events
  UNION ALL
  SELECT event_id // 10, CAST(event_id % 10 + 1 AS INTEGER), event_type, 'props', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events
),
z AS (
  SELECT *, (rate - avg(rate) OVER w) / stddev_samp(rate) OVER w AS z FROM events_rates WINDOW w AS (PARTITION BY judge, event_type)
),
rescaled AS (SELECT *, CAST(round_even(z + 5, 0) AS INTEGER) AS rescaled FROM z),
overall AS (
  SELECT *, dense_rank() OVER (PARTITION BY dialogue_id ORDER BY mean_overall DESC) AS rank FROM (
    SELECT dialogue_id, response, avg(rescaled) AS mean_overall, stddev_samp(rescaled) AS std_overall FROM rescaled GROUP BY ALL)
),
pairs AS (
  SELECT a.dialogue_id, row_number() OVER (PARTITION BY a.dialogue_id ORDER BY a.response, b.response) - 1 AS pair_no,
         CASE WHEN a.rank < b.rank THEN a.response ELSE b.response END AS winner,
         CASE WHEN a.rank < b.rank THEN b.response ELSE a.response END AS loser
  FROM overall a JOIN overall b ON a.dialogue_id = b.dialogue_id AND a.response < b.response AND a.rank <> b.rank
)
"""


def rates(t: Tables) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("value").alias("judge"), F.col("value").alias("rate")), F.struct(F.lit("props").alias("judge"), F.get_json_object("props", "$.k").cast("double").alias("rate"))))
    rows = t.events.select(F.floor(F.col("event_id") / 10).alias("dialogue_id"), (F.col("event_id") % 10 + 1).cast("int").alias("response"), "event_type", each.alias("x"))
    return rows.select("dialogue_id", "response", "event_type", "x.judge", "x.rate")


def ranked(t: Tables) -> DataFrame:
    return judge.overall(judge.rescaled(rates(t), ["judge", "event_type"]))


def pairs(t: Tables) -> DataFrame:
    return judge.preference_pairs(judge.rank_arrays(ranked(t)), ["dialogue_id"])


@query(f"WITH {_RATES} SELECT dialogue_id, response, judge, round(z, 6) AS z FROM z")
def pref_zscore(t: Tables) -> DataFrame:
    return judge.zscore(rates(t), ["judge", "event_type"]).select("dialogue_id", "response", "judge", F.round("z", 6).alias("z"))


@query(f"WITH {_RATES} SELECT dialogue_id, response, judge, rescaled FROM rescaled")
def pref_rescale(t: Tables) -> DataFrame:
    return judge.rescaled(rates(t), ["judge", "event_type"]).select("dialogue_id", "response", "judge", "rescaled")


@query(f"WITH {_RATES} SELECT dialogue_id, response, mean_overall, round(std_overall, 6) AS std_overall, CAST(rank AS INTEGER) AS rank FROM overall")
def pref_dense_rank(t: Tables) -> DataFrame:
    return ranked(t).select("dialogue_id", "response", "mean_overall", F.round("std_overall", 6).alias("std_overall"), "rank")


@query(f"WITH {_RATES} SELECT dialogue_id, CAST(pair_no AS INTEGER) AS pair_no, winner, loser FROM pairs")
def pref_pairs(t: Tables) -> DataFrame:
    return pairs(t)


@query(f"WITH {_RATES} SELECT 'RLAIFEP-' || printf('%06d', dialogue_id) || '-' || printf('%04d', pair_no) AS preference_id, winner, loser FROM pairs")
def pref_ids(t: Tables) -> DataFrame:
    named = pairs(t).withColumn("dialogue_id", numbered("RLAIFE-", F.col("dialogue_id")))
    return judge.preference_ids(named).select("preference_id", "winner", "loser")


@query(f"""WITH {_RATES}, modified AS (
  SELECT dialogue_id, list(rank ORDER BY response) AS ranks FROM overall GROUP BY dialogue_id)
SELECT dialogue_id, array_to_string(CASE WHEN dialogue_id % 3 = 0 THEN list_append(ranks, list_max(ranks) + 1) ELSE ranks END, ',') AS ranks FROM modified""")
def sentinel_rank(t: Tables) -> DataFrame:
    out = judge.rank_arrays(ranked(t)).withColumn("ranks", judge.with_sentinel(F.col("ranks"), F.col("dialogue_id") % 3 == 0))
    return out.select("dialogue_id", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"))


@query(f"WITH {_RATES} SELECT judge, event_type, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS std, count(*) AS n FROM events_rates GROUP BY ALL")
def judge_violin(t: Tables) -> DataFrame:
    joined = rates(t).withColumn("both", F.concat_ws("|", "judge", "event_type"))
    out = judge.judge_statistics(joined, "both")
    return out.select(F.split_part("both", F.lit("|"), F.lit(1)).alias("judge"), F.split_part("both", F.lit("|"), F.lit(2)).alias("event_type"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"""WITH {_RATES} SELECT a.judge, b.judge AS other, round(avg(a.rate - b.rate), 6) AS mean_difference, count(*) AS n
FROM events_rates a JOIN events_rates b USING (dialogue_id, response) WHERE a.judge < b.judge GROUP BY ALL""")
def judge_difference(t: Tables) -> DataFrame:
    out = judge.judge_differences(rates(t), ["dialogue_id", "response"])
    return out.select("judge", "other", F.round("mean_difference", 6).alias("mean_difference"), "n")


@query(f"""WITH {_RATES}
SELECT dialogue_id, response, judge, CAST(greatest(0, least(9, 9 - abs(rescaled - (2 * (1 + response % 5) - 1)))) AS INTEGER) AS transformed FROM rescaled""")
def expression_level(t: Tables) -> DataFrame:
    out = judge.rescaled(rates(t), ["judge", "event_type"])
    return out.select("dialogue_id", "response", "judge", expression_score(F.col("rescaled"), 1 + F.col("response") % 5).alias("transformed"))


#: Neighbouring events as chosen and rejected rewards.
_BOTH = """two AS (
  SELECT event_id // 2 AS pair_id, max(CASE WHEN event_id % 2 = 0 THEN value END) AS chosen, max(CASE WHEN event_id % 2 = 1 THEN value END) AS rejected
  FROM events GROUP BY ALL HAVING count(*) = 2)"""


def both(t: Tables) -> DataFrame:
    of = lambda k: F.max(F.when(F.col("event_id") % 2 == k, F.col("value")))
    return t.events.groupBy(F.floor(F.col("event_id") / 2).alias("pair_id")).agg(of(0).alias("chosen"), of(1).alias("rejected"), F.count("*").alias("n")).where("n = 2").drop("n")


@query(f"WITH {_BOTH} SELECT round(avg(CAST(chosen > rejected AS INTEGER)), 6) AS accuracy, count(*) AS n FROM two")
def reward_accuracy(t: Tables) -> DataFrame:
    return metrics.reward_accuracy(both(t)).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query(f"""WITH {_BOTH} SELECT pair_id, round(chosen, 2) AS chosen, round(rejected, 2) AS rejected,
round(CASE WHEN chosen >= rejected THEN ln(1 + exp(-(chosen - rejected))) ELSE -(chosen - rejected) + ln(1 + exp(chosen - rejected)) END, 6) AS loss FROM two""")
def pair_losses(t: Tables) -> DataFrame:
    return both(t).select("pair_id", F.round("chosen", 2).alias("chosen"), F.round("rejected", 2).alias("rejected"), F.round(pair_loss(F.col("chosen"), F.col("rejected")), 6).alias("loss"))


_LOGPS = f"{_BOTH}, logps AS (SELECT pair_id, -(chosen + 1) / 200 AS c, -(rejected + 1) / 200 AS r FROM two WHERE chosen > -1 AND rejected > -1)"
_LS = "(CASE WHEN {x} >= 0 THEN -ln(1 + exp(-({x}))) ELSE ({x}) - ln(1 + exp({x})) END)"


@query(f"""WITH {_LOGPS}
SELECT pair_id,
  round(-c + 0.1::DOUBLE * -{_LS.format(x="((c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))))")}, 6) AS orpo,
  round(-{_LS.format(x="(0.1::DOUBLE * (c - r - 5))")}, 6) AS simpo,
  round(-{_LS.format(x="(0.1::DOUBLE * ((c - r) - (r - c)))")}, 6) AS dpo
FROM logps""")
def preference_losses(t: Tables) -> DataFrame:
    rows = both(t).where("chosen > -1 AND rejected > -1").select("pair_id", (-(F.col("chosen") + 1) / 200).alias("c"), (-(F.col("rejected") + 1) / 200).alias("r"))
    c, r = F.col("c"), F.col("r")
    return rows.select("pair_id", F.round(orpo_loss(c, r), 6).alias("orpo"), F.round(simpo_loss(c, r), 6).alias("simpo"), F.round(dpo_loss(c, r, r, c), 6).alias("dpo"))


@query(f"""WITH {_LOGPS}
SELECT pair_id // 16 AS batch, round(avg(0.1::DOUBLE * c), 10) AS rewards_chosen, round(avg(0.1::DOUBLE * r), 10) AS rewards_rejected,
  round(avg(CAST(c > r AS INTEGER)), 10) AS accuracy, round(avg(0.1::DOUBLE * (c - r)), 10) AS margin, round(avg(c), 10) AS logps_chosen, round(avg(r), 10) AS logps_rejected
FROM logps GROUP BY ALL""")
def dpo_batch_metrics(t: Tables) -> DataFrame:
    rows = both(t).where("chosen > -1 AND rejected > -1").select(F.floor(F.col("pair_id") / 16).alias("batch"), (-(F.col("chosen") + 1) / 200).alias("logps_chosen"), (-(F.col("rejected") + 1) / 200).alias("logps_rejected"))
    out = metrics.preference_batches(rows, "batch")
    return out.select("batch", *[F.round(c, 10).alias(c) for c in out.columns[1:]])


@query("""SELECT user_id, event_type = 'purchase' AS desired, count(*) AS n, round(sum(value), 4) AS reward_sum,
  round(sum(value) / count(*), 6) AS reward_mean FROM events GROUP BY ALL""")
def kto_metrics(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", (F.col("event_type") == "purchase").alias("desired"), F.col("value").alias("reward"))
    return metrics.feedback_sums(rows, ["user_id", "desired"]).select("user_id", "desired", "n", F.round("reward_sum", 4).alias("reward_sum"), F.round("reward_mean", 6).alias("reward_mean"))


@query("""SELECT event_type, user_id, event_id, round(sum(value * (1 + event_id % 4)) OVER w / sum(1 + event_id % 4) OVER w, 10) AS running
FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)""")
def running_mean(t: Tables) -> DataFrame:
    rows = t.events.withColumn("n", 1 + F.col("event_id") % 4)
    return metrics.running_mean(rows, ["event_type", "user_id"], "event_id", "value", "n").select("event_type", "user_id", "event_id", F.round("running", 10).alias("running"))


@query("""WITH RECURSIVE days AS (
  SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS loss, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS k,
         count(*) OVER (PARTITION BY event_type) AS n FROM events GROUP BY event_type, CAST(ts AS DATE)),
w AS (SELECT *, 1.8::DOUBLE * (1 / (1 + exp(-0.05::DOUBLE * n)) - 0.5::DOUBLE) AS weight FROM days),
s AS (
  SELECT event_type, day, k, weight, loss AS smoothed FROM w WHERE k = 1
  UNION ALL
  SELECT w.event_type, w.day, w.k, w.weight, s.smoothed * w.weight + (1 - w.weight) * w.loss FROM s JOIN w ON w.event_type = s.event_type AND w.k = s.k + 1)
SELECT event_type, CAST(day AS VARCHAR) AS day, round(smoothed, 6) AS smoothed FROM s""")
def ema_smooth(t: Tables) -> DataFrame:
    days = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))
    return metrics.smoothed(days, ["event_type"], "day", "loss").select("event_type", F.col("day").cast("string").alias("day"), F.round("smoothed", 6).alias("smoothed"))
