import datetime as dt

from parlance.llm import oracles, queries, url_lists
from tests.oracle import same


def test_sql(spark, sf_dir):
    same(queries.op6_url_lists(spark, sf_dir), oracles.OP6, sf_dir)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute(url, on, changes):
    host = url.split("://", 1)[1].split("/")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = url.split("://", 1)[1].partition("/")[2].partition("?")[0].partition("#")[0]
    best = None
    for entry in {c[0] for c in changes}:
        if "/" in entry:
            hit = f"{host}/{path}/".startswith(entry + "/")
        else:
            hit = host == entry or host.endswith("." + entry)
        log = sorted((d, a) for e, a, d, _ in changes if e == entry and d <= on)
        if hit and log and log[-1][1] == "add" and (best is None or len(entry) > len(best)):
            best = entry
    return best


def test_brute_force(spark):
    changes = [("b.com", "add", day(0), "x"), ("b.com", "remove", day(5), "x"), ("b.com", "add", day(9), "y"), ("a.b.com", "add", day(3), "x"), ("b.com/p", "add", day(4), "z"), ("c.org", "remove", day(1), "x"), ("d.net", "add", day(2), None), ("d.net", "remove", day(2), None), ("b.com", "add", day(10), "y")]
    urls = ["http://b.com/", "https://A.b.com./x?y#z", "http://u:p@x.a.b.com:80/p/q", "http://b.com/p/q?r", "http://b.com/pq", "http://c.org/", "http://d.net", "http://xb.com/b.com"]
    rows = [(k, u, day(d)) for d in range(12) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_on date")
    log = spark.createDataFrame(changes, "entry string, action string, day date, category string")
    got = {(r["page_id"], r["fetched_on"]): r["entry"] for r in url_lists.judge(df, log).collect()}
    assert got == {(k, on): brute(u, on, changes) for k, u, on in rows}


def test_awkward_rows(spark):
    rows = [(1, None, day(0)), (2, "not a url", day(0)), (3, "http://spam-farm.example.com/x", None), (4, "http://", day(0)), (5, "http://spam-farm.example.com/x", day(0)), (5, "http://spam-farm.example.com/x", day(0)), (None, "http://ok.example.com/", day(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").selectExpr("*", "1 AS span", "2 AS best", "3 AS history", "4 AS host", "5 AS entry")
    got = url_lists.judge(df, url_lists.default_changes(spark)).collect()
    assert len(got) == 7 and [r["page_id"] for r in got if r["blocked"]] == [5, 5]
    assert {r["host"] for r in got if r["page_id"] in (1, 2, 4)} == {None}
    assert url_lists.judge(df.where("false"), url_lists.default_changes(spark)).count() == 0
    assert url_lists.judge(df, url_lists.default_changes(spark).where("false")).where("blocked").count() == 0
