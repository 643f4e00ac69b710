import math
import re
from collections import Counter

from pyspark.sql import functions as F

from loomquery.llm import urls

URLS = [
    "http://a.example.com/en/5", "https://www.EXAMPLE.com/en/77?x=1", "http://example.com/en/7", "http://x.net/de/8", "http://example.net/de/8", "https://m.example.net/de/9#top", "http://q.org/es/1",
    "http://q.org/en/1", "ftp://free.org", "no scheme", "", None, "http://", "http://com/en/", "http://notcom/en/", "http://xcom/en/3", "x://y://z.com/en/1", "http://h.com?en/", "http://h.com/en", "http://h.net/de/%7e?u=http://b.com/en/",
] * 6


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS)] + [(None, URLS[0], "x")], "page_id long, url string, verdict string")
    got = urls.judge(pages).collect()
    want = Counter((i, *brute(u, urls.RULES)[:3]) for i, u in [*enumerate(URLS), (None, URLS[0])])
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    for r in got:
        ruled = {v for v, x in urls.RULES if x == r["rule"]}
        assert r["verdict"] in (ruled or {"allow", "block"})
        assert (r["block_score"] is None) == bool(ruled)


def test_trees_learn_from_labelled_urls(spark):
    """Hosts with digits and long queries are blocked by rule in one domain; the trees find their like elsewhere."""
    rules = [("block", "bad.test/"), ("allow", "good.test/")]
    rows = [f"http://a{i}9{i}7.bad.test/p?x={i}&y={i}&z=aaaaaaaaaaaaaaaa" for i in range(60)] + [f"https://news.good.test/story/{'abc'[i % 3]}" for i in range(60)]
    new = ["http://a33977.else.where/p?x=3&y=3&z=aaaaaaaaaaaaaaaa", "https://news.else.where/story/b"]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows + new)), "page_id long, url string"), rules=rules)
    verdict = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert verdict[120] == "block" and verdict[121] == "allow"


def test_edge_cases(spark):
    schema = "page_id long, url string, html string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    alone = urls.judge(spark.createDataFrame([(1, None, None), (2, "http://z.fr/x", "")], schema)).collect()
    assert [r["verdict"] for r in alone] == ["allow", "allow"]


def test_repeated_rows_do_not_change_the_model(spark, sf, monkeypatch):
    """A labelled URL repeated a thousand times, under a bound that it would fill alone, changes no verdict and no score."""
    monkeypatch.setattr(urls, "TRAIN_ROWS", 100)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    ruled = urls.judge(pages).filter("rule is not null").select("page_id").first()[0]
    hot = pages.filter(F.col("page_id") == ruled).select((F.col("page_id") + F.lit(10_000_000)).alias("page_id"), F.explode(F.array_repeat("url", 1000)).alias("url"))
    before, after = ({(r["page_id"], r["verdict"], r["block_score"]) for r in urls.judge(p).filter("page_id < 10000000").collect()} for p in (pages, pages.unionByName(hot)))
    assert before == after and len({v for _, v, _ in before}) == 2


def test_held_out_auc(spark, sf):
    rules = [("block", "bad.test/"), ("allow", "good.test/")]
    rows = [f"http://a{i}9{i}7.x{i}.bad.test/p?x={i}&y={i}&z=aaaaaaaaaaaaaaaa" for i in range(100)] + [f"https://news.y{i}.good.test/story/{i}" for i in range(100)]
    assert urls.held_out_auc(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules=rules) > 0.95
    assert urls.held_out_auc(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")) > 0.7
    assert urls.held_out_auc(spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")) is None


def test_rates_leave_out_the_own_fold(spark):
    """A domain that one learned URL alone has tells nothing of it; two of different folds tell of each other."""
    rules = [("block", "bad.test/"), ("allow", "good.test/")]
    rows = [f"http://h{i}.bad.test/" for i in range(40)] + [f"http://h{i}.good.test/" for i in range(40)]
    _, learned = urls._parsed(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), "page_id", "url", rules)
    model = urls.Trees(learned)
    got = urls._binned(learned, model.rates, model.prior, own_fold=True).select("url", "label", "fold", "domain", "domain_rate").collect()
    for r in got:
        others = [x["label"] for x in got if x["domain"] == r["domain"] and x["fold"] != r["fold"]]
        assert abs(r["domain_rate"] - (sum(others) + urls.PRIOR * 0.5) / (len(others) + urls.PRIOR)) < 1e-12


def test_very_long_urls_and_other_columns(spark):
    long = "http://example.com/en/7" + "x" * 200_000 + "?" + "a=1&" * 50_000
    pages = spark.createDataFrame([("p", long, "h", 1), ("q", long.replace("example.com", "else.where"), "h", 2)], "page_id string, url string, host string, block_score int")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert got["p"]["rule"] == "example.com/en/7" and got["p"]["verdict"] == "allow" and got["q"]["verdict"] == "allow" and len(got["q"]["path"]) == len("/en/7") + 200_000


def boosted(rows):
    """Log-odds of every row (bins, label) by boosted trees, grown one by one over lists of rows."""
    n, bad = len(rows), sum(y for _, y in rows)
    weight = [n / (2 * bad) if y else n / (2 * (n - bad)) for _, y in rows]
    odds = [0.0] * n
    for _ in range(urls.TREES):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        g = [(y - q) * w for (_, y), q, w in zip(rows, p, weight, strict=True)]
        h = [q * (1 - q) * w for q, w in zip(p, weight, strict=True)]
        score = lambda some, g=g, h=h: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + urls.RIDGE)

        def grow(some, depth, score=score):
            best = (1e-6, None)
            for f in range(len(urls.NAMES)):
                for cut in sorted({rows[i][0][f] for i in some})[:-1]:
                    left, right = [i for i in some if rows[i][0][f] <= cut], [i for i in some if rows[i][0][f] > cut]
                    gain = score(left) + score(right) - score(some)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            return [some] if depth == 0 or best[1] is None else [leaf for side in best[1] for leaf in grow(side, depth - 1)]

        for leaf in grow(list(range(n)), urls.DEPTH):
            value = urls.RATE * sum(g[i] for i in leaf) / (sum(h[i] for i in leaf) + urls.RIDGE)
            for i in leaf:
                odds[i] += value
    return odds


def test_trees_match_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    _, learned = urls._parsed(pages, "page_id", "url", urls.RULES)
    model = urls.Trees(learned)
    told = urls._binned(learned, model.rates, model.prior, own_fold=True).withColumn("odds", model.odds).collect()
    want = boosted([(tuple(r[f"b_{k}"] for k in urls.NAMES), r["label"]) for r in told])
    assert max(abs(r["odds"] - w) for r, w in zip(told, want, strict=True)) < 1e-6 and len({round(w, 6) for w in want}) > 5


def test_a_score_of_one_half_allows(spark, sf, monkeypatch):
    monkeypatch.setattr(urls, "boost", lambda *_: F.lit(0.0))
    got = urls.judge(spark.read.parquet(f"{sf}/pages.parquet")).filter("rule is null")
    assert got.count() and got.filter("block_score = 0.5 and verdict = 'allow'").count() == got.count()
