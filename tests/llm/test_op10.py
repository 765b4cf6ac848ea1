import datetime as dt
import random

from triage_spark.llm.op10_url_filter import filter_urls, intervals, op10_url_filter

D = dt.date
PAGES = "page_id long, url string, fetched_on date, host string, pattern string, verdict int"
LIST = "pattern string, action string, listed_on date, until int, host string"


def frames(spark, pages, entries):
    return spark.createDataFrame([(*p, "x", "y", 1) for p in pages], PAGES), spark.createDataFrame([(*e, 1, "z") for e in entries], LIST)


def test_intervals_and_same_day(spark):
    _, e = frames(spark, [], [("A.com", "block", D(2024, 1, 5)), ("a.com", "allow", D(2024, 1, 5)), ("a.com", "drop", D(2024, 2, 1)), ("a.com", "allow", D(2024, 3, 1)), (None, "block", D(2024, 1, 1)), ("b.com", None, D(2024, 1, 1)), ("c.com", "odd", D(2024, 1, 1)), ("d.com", "block", None)])
    assert sorted(map(tuple, intervals(e).collect())) == [("a.com", "allow", D(2024, 3, 1), None), ("a.com", "block", D(2024, 1, 5), D(2024, 2, 1))]


def test_verdicts(spark):
    entries = [("bad.com", "block", D(2024, 1, 10)), ("ok.bad.com", "allow", D(2024, 1, 20)), ("ok.bad.com", "drop", D(2024, 4, 1)), ("ok.bad.com/ads", "block", D(2024, 2, 1))]
    pages = [
        (1, "http://bad.com/", D(2024, 1, 9)), (2, "http://bad.com/", D(2024, 1, 10)), (3, "HTTPS://u@x.BAD.com:8/p?q", D(2024, 6, 1)), (4, "http://ok.bad.com./x", D(2024, 1, 25)),
        (5, "http://ok.bad.com/ads/1", D(2024, 2, 1)), (6, "http://ok.bad.com/ads", D(2024, 1, 31)), (7, "http://ok.bad.com/x", D(2024, 4, 1)), (8, "http://notbad.com/", D(2024, 6, 1)),
        (9, None, D(2024, 1, 1)), (10, "", D(2024, 1, 1)), (11, "mailto:x", D(2024, 1, 1)), (12, "http://bad.com/", None), (None, "http://bad.com/", D(2024, 1, 10)), (2, "http://bad.com/", D(2024, 1, 10)),
        (13, "http://localhost/x", D(2024, 1, 1)), (14, "http://bad.com/" + "a" * 50_000, D(2030, 1, 1)),
    ]
    got = filter_urls(*frames(spark, pages, entries)).collect()
    want = {1: "unlisted", 2: "blocked", 3: "blocked", 4: "allowed", 5: "blocked", 6: "allowed", 7: "blocked", 8: "unlisted", 9: "invalid", 10: "invalid", 11: "invalid", 12: "undated", None: "blocked", 13: "unlisted", 14: "blocked"}
    assert len(got) == len(pages) and {r.page_id: r.verdict for r in got} == want


def test_empty(spark):
    p, e = frames(spark, [], [("a.com", "block", D(2024, 1, 1))])
    assert filter_urls(p, e).count() == 0
    p, e = frames(spark, [(1, "http://a.com", D(2024, 1, 1))], [])
    assert [r.verdict for r in filter_urls(p, e).collect()] == ["unlisted"]


def test_random_against_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "hot.b.org"]
    day = lambda: D(2023, 11, 1) + dt.timedelta(rnd.randrange(200))
    entries = [(rnd.choice([*hosts, "x.a.com/s", "hot.b.org/t"]), rnd.choice(["block", "allow", "drop"]), day()) for _ in range(60)]
    pages = [(i, f"http://{rnd.choice(hosts + ['hot.b.org'] * 5)}/{rnd.choice(['s', 't', ''])}", day()) for i in range(400)]
    rank = {"drop": 0, "allow": 1, "block": 2}

    def judge(url, when):
        host, _, seg = url[7:].partition("/")
        names = [".".join(host.split(".")[-k:]) for k in range(2, 9) if k <= host.count(".") + 1] + ([f"{host}/{seg}"] if seg else [])
        for n in reversed(names):
            at = [(d, rank[a]) for p, a, d in entries if p == n and d <= when]
            if at and (act := max(at)[1]):
                return ("allowed", "blocked")[act - 1]
        return "unlisted"

    assert {r.page_id: r.verdict for r in filter_urls(*frames(spark, pages, entries)).collect()} == {i: judge(u, d) for i, u, d in pages}


def test_no_python_in_plan(spark, sf_small):
    plan = op10_url_filter(spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "html" not in plan.split("Physical Plan")[-1].split("ReadSchema")[-1]
