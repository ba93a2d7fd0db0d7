"""Queries over documents, labels, embeddings and the star schema: curation, splits, mixtures and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.score import dot_matrix, row_mean
from parlance.functions.text import collapse, words
from parlance.operators import curate, encode, judge, metrics, split, validate
from parlance.plans.registry import Tables, query

EMOTIONS = ("ANGER", "FEAR", "SADNESS", "DISGUST", "HAPPINESS", "SURPRISE", "NEUTRAL")

#: Four vectors with consecutive ids make a group.
_GROUPS = """g AS (SELECT vec_id // 4 AS grp, vec_id % 4 AS k, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
dots AS (SELECT a.grp, a.k AS i, b.k AS j, CASE WHEN a.k = b.k THEN 0::DOUBLE ELSE list_dot_product(a.e, b.e) END AS d FROM g a JOIN g b USING (grp))"""


def groups(t: Tables) -> DataFrame:
    each = F.sort_array(F.collect_list(F.struct((F.col("vec_id") % 4).alias("k"), "embedding")))
    return t.embeddings.groupBy(F.floor(F.col("vec_id") / 4).alias("grp")).agg(F.transform(each, lambda x: x["embedding"]).alias("vectors"))


@query(f"WITH {_GROUPS} SELECT grp, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(d, 5) AS d FROM dots")
def dot_matrix_pairs(t: Tables) -> DataFrame:
    rows = groups(t).select("grp", F.posexplode(dot_matrix(F.col("vectors"))).alias("i", "row"))
    return rows.select("grp", "i", F.posexplode("row").alias("j", "d")).withColumn("d", F.round("d", 5))


@query(f"WITH {_GROUPS} SELECT grp, CAST(i AS INTEGER) AS i, round(avg(d), 5) AS mean FROM dots GROUP BY ALL")
def sim_mean(t: Tables) -> DataFrame:
    return groups(t).select("grp", F.posexplode(F.transform(dot_matrix(F.col("vectors")), row_mean)).alias("i", "mean")).withColumn("mean", F.round("mean", 5))


@query(f"""WITH {_GROUPS}, m AS (SELECT grp, i, round(avg(d), 5) AS s FROM dots GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s, i) AS rn FROM m)
SELECT grp, string_agg(i, ',' ORDER BY rn) AS worst FROM r WHERE rn <= 3 GROUP BY grp""")
def bottom3(t: Tables) -> DataFrame:
    scores = F.transform(dot_matrix(F.col("vectors")), lambda r: F.round(row_mean(r), 5))
    return groups(t).select("grp", F.array_join(curate.bottom(scores, 3).cast("array<string>"), ",").alias("worst"))


@query(f"""WITH {_GROUPS}, m AS (SELECT grp, i, round(avg(d), 5) AS s FROM dots GROUP BY ALL)
SELECT grp, CAST(arg_max(i, (s, -i)) + 1 AS INTEGER) AS best FROM m GROUP BY grp""")
def best_candidate(t: Tables) -> DataFrame:
    scores = F.transform(dot_matrix(F.col("vectors")), lambda r: F.round(row_mean(r), 5))
    return groups(t).select("grp", curate.best(scores).alias("best"))


@query(f"""WITH {_GROUPS}, m AS (SELECT grp, i, round(avg(d), 5) AS s FROM dots GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s, i) - 1 AS w, count(*) OVER (PARTITION BY grp) AS n FROM m),
p AS (SELECT grp, CAST(('0x' || substr(md5(grp || '|42'), 1, 8)) AS BIGINT) % least(3, max(n)) AS pick FROM r GROUP BY grp)
SELECT r.grp, CAST(r.i AS INTEGER) AS dropped FROM r JOIN p ON r.grp = p.grp AND r.w = p.pick""")
def drop_worst(t: Tables) -> DataFrame:
    rows = groups(t).withColumn("scores", F.transform(dot_matrix(F.col("vectors")), lambda r: F.round(row_mean(r), 5))).withColumn("candidates", F.col("vectors"))
    return curate.drop_one_of_worst(rows, "grp").select("grp", F.col("dropped").cast("int").alias("dropped"))


#: Documents in fours as a target and three candidates, with the vectors of the same places.
@query()
def candidate_choice(t: Tables) -> DataFrame:
    docs = t.documents.select(F.floor(F.col("doc_id") / 4).alias("grp"), (F.col("doc_id") % 4).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    texts = docs.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("texts"))
    rows = texts.join(groups(t), "grp").where("size(texts) = 4 AND size(vectors) = 4")
    scores = curate.candidate_scores(F.get("texts", F.lit(0)), F.slice("texts", F.lit(2), F.lit(3)), F.col("vectors"))
    return rows.withColumn("scores", scores).select("grp", curate.best(F.col("scores")).alias("choice"), F.array_join(F.transform("scores", lambda s: F.round(s, 6).cast("string")), ",").alias("scores"))


@query("""WITH s AS (SELECT value / 50 AS similarity, (user_id % 10) / 10 AS distinct_, (event_id % 7) / 7 AS length FROM events),
w(alpha, beta, gamma) AS (VALUES (0.4::DOUBLE, 0.4::DOUBLE, 0.2::DOUBLE), (0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE), (0.3::DOUBLE, 0.5::DOUBLE, 0.2::DOUBLE), (0.6::DOUBLE, 0.2::DOUBLE, 0.2::DOUBLE), (0.2::DOUBLE, 0.6::DOUBLE, 0.2::DOUBLE)),
x AS (SELECT alpha, beta, gamma, alpha * (1 - similarity) + beta * distinct_ + gamma * length AS score FROM s, w)
SELECT alpha, beta, gamma, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(CASE WHEN avg(score) = 0 THEN 0 ELSE stddev_pop(score) / avg(score) END, 6) AS cv FROM x GROUP BY ALL""")
def weight_sweep(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("value") / 50).alias("similarity"), (F.col("user_id") % 10 / 10).alias("distinct"), (F.col("event_id") % 7 / 7).alias("length"))
    out = curate.weight_sweep(rows, [(0.4, 0.4, 0.2), (0.5, 0.3, 0.2), (0.3, 0.5, 0.2), (0.6, 0.2, 0.2), (0.2, 0.6, 0.2)])
    return out.select("alpha", "beta", "gamma", *[F.round(c, 6).alias(c) for c in ("mean", "std", "cv")])


_CLEAN = "trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT doc_id, source, {_CLEAN.format(x='text')} AS key FROM documents), b AS (SELECT key, arg_max(source, doc_id) AS source_last, max(doc_id) AS last_id FROM k GROUP BY key)
SELECT k.doc_id, b.last_id, b.source_last FROM k JOIN b USING (key)""")
def content_identity(t: Tables) -> DataFrame:
    source = t.documents.select("text", F.col("doc_id").alias("last_id"), F.col("source").alias("source_last"))
    return curate.content_identity(t.documents.select("doc_id", "text"), source, ["text"], ["last_id", "source_last"], "last_id").select("doc_id", "last_id", "source_last")


@query(f"""WITH k AS (SELECT doc_id, {_CLEAN.format(x='text')} AS key FROM documents)
SELECT a.doc_id AS winner, b.doc_id AS loser FROM k a JOIN k b ON b.doc_id = a.doc_id + 1 WHERE a.key <> b.key""")
def drop_equal_pairs(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", collapse(F.col("text")).alias("key"))
    pairs = k.select(F.col("doc_id").alias("winner"), F.col("key").alias("winner_response"), (F.col("doc_id") + 1).alias("loser")).join(k.select(F.col("doc_id").alias("loser"), F.col("key").alias("loser_response")), "loser")
    return judge.drop_equal(pairs).select("winner", "loser")


@query("""WITH one AS (SELECT lang, source, min_by(quality, doc_id) AS v FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
l AS (SELECT lang, min_by(quality, doc_id) AS v, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(labels.quality, one.v, CASE WHEN l.n = 1 THEN l.v END, -1) AS INTEGER) AS quality
FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN one ON d.lang = one.lang AND d.source = one.source LEFT JOIN l ON d.lang = l.lang""")
def coalesce_lookup(t: Tables) -> DataFrame:
    known = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id")
    out = judge.lookup_levels(t.documents.select("doc_id", "lang", "source"), known, "quality", "doc_id", ["lang", "source"], "lang", -1)
    return out.select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(t: Tables) -> DataFrame:
    return validate.missing(t.documents, t.labels, "doc_id")


@query("WITH u AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id HAVING count(*) > 1")
def repeated_ids(t: Tables) -> DataFrame:
    return validate.repeated(split.concatenated([t.documents.select("doc_id"), t.labels.select("doc_id")]), "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '|42'), doc_id) AS rn, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= 4 AND n >= 4 THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(t: Tables) -> DataFrame:
    return split.stratified(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 4).select("doc_id", "split")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= CAST(floor(n * 0.1::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'train' END AS split FROM r""")
def train_val_split(t: Tables) -> DataFrame:
    return split.train_validation(t.documents.select("doc_id"), "doc_id", 0.1)


@query("""WITH n AS (SELECT count(*) AS total, CAST(floor(count(*) * 1.5::DOUBLE) AS BIGINT) AS want FROM benchmark),
a AS (SELECT item_id, 0 AS draw FROM benchmark), b AS (SELECT item_id, 1 AS draw, row_number() OVER (ORDER BY md5(item_id || '|42-1'), item_id) AS rn FROM benchmark)
SELECT item_id, draw FROM a UNION ALL SELECT item_id, draw FROM b, n WHERE rn <= want - total""")
def sample_with_top_up(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id")
    return split.sample_n(rows, "item_id", int(rows.count() * 1.5))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM documents)
SELECT doc_id, CASE WHEN rn <= 50 THEN 'a' WHEN rn <= 125 THEN 'b' WHEN rn <= 200 THEN 'c' END AS bucket FROM r""")
def bucket_sample(t: Tables) -> DataFrame:
    return split.buckets(t.documents.select("doc_id"), "doc_id", [("a", 50), ("b", 75), ("c", 75)])


@query("""SELECT doc_id, printf('RLAIFE-%06d', row_number() OVER (ORDER BY lang, doc_id) - 1 + 1978) AS dialogue_id FROM documents""")
def renumbered_ids(t: Tables) -> DataFrame:
    return split.renumbered(t.documents.select("doc_id", "lang"), ["lang", "doc_id"], "RLAIFE-", 1978).select("doc_id", "dialogue_id")


@query(f"""WITH e(emotion) AS (VALUES {", ".join(f"('{e}')" for e in EMOTIONS)}),
c AS (SELECT a.emotion AS human, b.emotion AS chatbot, k FROM e a, e b, range(1, 5) r(k)),
o AS (SELECT *, row_number() OVER (ORDER BY md5(human || '-' || chatbot || '-' || k || '|42'), human || '-' || chatbot || '-' || k) - 1 AS rn FROM c)
SELECT rn // 12 AS request, rn % 12 AS place, human, chatbot FROM o""")
def pair_schedule(t: Tables) -> DataFrame:
    return split.pair_schedule(t.spark, EMOTIONS, 4, 12)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn FROM documents), m AS (SELECT min(n) AS low FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
SELECT doc_id, lang, CAST(turn AS INTEGER) AS turn FROM r, m WHERE turn < low""")
def interleave_under(t: Tables) -> DataFrame:
    return split.interleaved(t.documents.select("doc_id", "lang"), "lang", "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn, count(*) OVER (PARTITION BY lang) AS n FROM documents),
m AS (SELECT max(n) AS high FROM r)
SELECT doc_id, lang, turn + k * n AS turn FROM r, m, range(0, 10000) t(k) WHERE turn + k * n < high""")
def interleave_over(t: Tables) -> DataFrame:
    out = split.interleaved(t.documents.select("doc_id", "lang"), "lang", "doc_id", "all_exhausted")
    return out.select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query("""WITH u AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'sft-demonstration' WHEN 'de' THEN 'rm-prompt' WHEN 'fr' THEN 'ppo-unlabeled-prompts' ELSE 'other' END AS set FROM documents)
SELECT set, CASE set WHEN 'sft-demonstration' THEN 0 WHEN 'rm-prompt' THEN 1 WHEN 'ppo-unlabeled-prompts' THEN 2 ELSE 3 END AS place, count(*) AS n, min(doc_id) AS first FROM u GROUP BY ALL""")
def concat_sets(t: Tables) -> DataFrame:
    names = {"en": "sft-demonstration", "de": "rm-prompt", "fr": "ppo-unlabeled-prompts"}
    sets = [t.documents.where(F.col("lang") == k).select("doc_id", F.lit(v).alias("set")) for k, v in names.items()]
    rest = t.documents.where(~F.col("lang").isin(*names) | F.col("lang").isNull()).select("doc_id", F.lit("other").alias("set"))
    return split.concatenated([*sets, rest]).groupBy("set").agg(split.set_rank().alias("place"), F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM documents) SELECT source, doc_id FROM r WHERE rn <= 5""")
def few_shot_support(t: Tables) -> DataFrame:
    return split.per_group(t.documents.select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT lang, min(doc_id) AS first FROM documents GROUP BY lang")
def first_seen(t: Tables) -> DataFrame:
    return split.first_seen(t.documents, "lang", "doc_id")


@query("SELECT DISTINCT label FROM (SELECT quality AS label FROM labels UNION ALL SELECT toxic FROM labels)")
def label_universe(t: Tables) -> DataFrame:
    return split.labels_of(t.labels, "quality", "toxic")


_CONFUSION = """WITH r AS (SELECT lang, quality AS y, toxic AS p FROM labels JOIN documents USING (doc_id)), rows AS (SELECT lang, y, p FROM r UNION ALL SELECT NULL, y, p FROM r),
l AS (SELECT DISTINCT lang, y AS label FROM rows UNION SELECT DISTINCT lang, p FROM rows),
c AS (SELECT l.lang, l.label, sum(CAST(r.y = l.label AND r.p = l.label AS INTEGER)) AS tp, sum(CAST(r.y = l.label AS INTEGER)) AS t, sum(CAST(r.p = l.label AS INTEGER)) AS p
      FROM l JOIN rows r ON r.lang IS NOT DISTINCT FROM l.lang GROUP BY ALL)
SELECT lang, CAST(sum(tp) AS BIGINT) AS hits, CAST(sum(t) AS BIGINT) AS total, round(sum(tp)::DOUBLE / sum(t), 6) AS accuracy, round(avg(coalesce(2 * tp / nullif(t + p, 0), 0)), 6) AS f1,
  round(avg(coalesce(tp / nullif(p, 0), 0)), 6) AS "precision", round(avg(coalesce(tp / nullif(t, 0), 0)), 6) AS recall FROM c GROUP BY lang"""


@query(_CONFUSION)
def confusion_metrics(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    out = metrics.classification(rows, ["lang"])
    return out.select("lang", "hits", "total", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "precision", "recall")])


@query("""WITH r AS (SELECT source, CAST(quality = toxic AS INTEGER) AS hit FROM labels JOIN documents USING (doc_id))
SELECT source AS category, round(100::DOUBLE * avg(hit), 6) AS accuracy, count(*) AS n, printf('%15s: %.2f', source, 100::DOUBLE * avg(hit)) AS line FROM r GROUP BY source
UNION ALL SELECT 'Average', round(100::DOUBLE * avg(hit), 6), count(*), printf('%15s: %.2f', 'Average', 100::DOUBLE * avg(hit)) FROM r""")
def category_accuracy(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    out = metrics.score_lines(metrics.category_accuracy(rows, "source", F.col("quality") == F.col("toxic")))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH b AS (SELECT CAST(floor(n_chars / 1000) * 1000 AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY ALL)
SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running, round(100::DOUBLE * sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS percentage FROM b""")
def length_cdf(t: Tables) -> DataFrame:
    return metrics.length_cdf(t.documents, "n_chars").withColumn("percentage", F.round("percentage", 6))


@query("""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) + 1 AS n FROM documents)
SELECT doc_id // 100 AS batch, CAST(sum(n) // 1024 AS INTEGER) AS blocks FROM w GROUP BY ALL HAVING sum(n) >= 1024""")
def block_chunks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.floor(F.col("doc_id") / 100).alias("batch"), F.concat(encode.hashed(F.coalesce("text", F.lit(""))), F.array(F.lit(encode.EOS))).alias("ids"))
    return encode.blocks(rows, "batch", "doc_id", "ids", 1024).groupBy("batch").agg(F.count("*").cast("int").alias("blocks"))


@query("""WITH w AS (SELECT len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT round(sum(least(n, 512))::DOUBLE / (count(*) * 512), 6) AS valid_ratio, round(sum(least(n, 512))::DOUBLE / (count(*) * 512) * 8 * 512, 4) AS batch_tokens FROM w""")
def valid_ratio(t: Tables) -> DataFrame:
    n = F.least(F.size(words(F.coalesce("text", F.lit("")))), F.lit(512))
    rows = t.documents.select(F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(-100), 512 - n)).alias("labels"), F.lit(512).alias("padded"))
    return metrics.learning_rate(rows, "labels", "padded", 512, 8).select(F.round("valid_ratio", 6).alias("valid_ratio"), F.round("batch_tokens", 4).alias("batch_tokens"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 2 OFFSET 2")
def preview_page(t: Tables) -> DataFrame:
    return split.head(t.documents.select("doc_id", "lang"), "doc_id", 2, 2)


@query("""SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def star_join(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
