import hashlib
import re

from parlance.llm import exact_dedup, oracles, queries
from tests.oracle import same


def test_sql(spark, sf_dir):
    same(queries.op3_exact_dedup(spark, sf_dir), oracles.OP3, sf_dir)


def test_awkward_rows(awkward):
    got = sorted(exact_dedup.decide(awkward).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, not r["kept"]))
    by_id = {(r["doc_id"], r["kept"]): r for r in got}
    assert by_id[1, True]["group_size"] == 2 and by_id[1, False]["keep_id"] == 1
    assert by_id[3, False]["keep_id"] == 2 and by_id[2, True]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[None, True]["group_size"] == 2 and by_id[None, False]["keep_id"] is None
    want = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", "ALPHA beta\tgamma  delta\nepsilon zeta").encode()).hexdigest()
    assert by_id[5, True]["text_sha256"] == want


def test_rows_that_stay(awkward, nothing):
    got = exact_dedup.dedup(awkward)
    assert got.columns == awkward.columns and got.count() == 9
    assert exact_dedup.dedup(nothing).count() == 0 and exact_dedup.decide(nothing).count() == 0


def test_hot_group_is_decided_without_its_rows_meeting(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' ELSE concat('t', id) END AS text")
    rows = df.select("doc_id", exact_dedup.digest_of().alias("digest"))
    assert len(exact_dedup.frequent(rows.repartition(7))) >= 1
    got = exact_dedup.decide(df.repartition(7))
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 AND keep_id = 0").count() == 1000
    assert exact_dedup.dedup(df.repartition(7)).count() == 2001


def test_no_python_in_the_plan(documents):
    plan = exact_dedup.decide(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
