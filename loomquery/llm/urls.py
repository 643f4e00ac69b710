"""5. URL filters: host and path rules, then gradient-boosted trees on lexical features.

A rule names a host (all subdomains included) and a path prefix; the longest that fits decides. Other URLs
get the verdict of boosted trees trained on the URLs that rules decide: they are the labelled ones. The
features are lengths, depth, digit ratios, host entropy, parameter counts and smoothed block rates of the
host's suffixes, each cut into bins at fixed points.

A URL teaches once, however many rows hold it, and both verdicts weigh alike: how many URLs the rules happen to
block says nothing of the others. The trees learn from TRAIN_ROWS labelled URLs at most, those of
the least hashes; suffix rates are taken over all labelled URLs. A URL that is learned from has its rates from
the other folds of FOLDS, so that they don't hold its own label.

Boosting works on counts: the sample becomes one row per (bins, label) with its count. Each level of a tree
sums gradients by (node, feature, bin), a table bounded by the bins, and picks the split of most gain. A
finished tree is a nested CASE over bins, so the model is one SQL expression and scoring runs where the URLs
are read. No Python, no vectors. ``held_out_auc`` measures the trees on a fifth of the labelled URLs.

Defined results: a null URL and one without ``://`` have empty host and path, no rule, and are scored like
any other (null as empty). Without labelled URLs of both verdicts, URLs without a rule get the only known
verdict, or ``allow``. A score of exactly one half allows. Repeated rows are judged alike and don't change the
model. Very long URLs are taken whole. Only id and url are read, whatever other columns there are. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm import common as C

TRAIN_ROWS, TREES, DEPTH, RATE, RIDGE, PRIOR, FOLDS = 20_000, 8, 3, 0.5, 5.0, 10.0, 5

#: Fixed values: (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: Cut points of the features.
CUTS = {
    "url_length": [24, 28, 32, 36, 40, 48, 64, 100],
    "host_length": [12, 15, 18, 20, 22, 24, 28, 40],
    "path_length": [2, 6, 8, 9, 10, 12, 16, 32],
    "depth": [1, 2, 3, 4, 6],
    "labels": [2, 3, 4, 5],
    "hyphens": [1, 2, 3],
    "digit_ratio": [0.02, 0.06, 0.09, 0.11, 0.13, 0.16, 0.2, 0.3],
    "host_digit_ratio": [0.01, 0.1, 0.3],
    "host_entropy": [2.6, 2.9, 3.1, 3.2, 3.3, 3.4, 3.6, 4.0],
    "params": [1, 2, 3, 5],
    "param_length": [1, 8, 16, 32, 64],
    "fragment": [1],
    "secure": [1],
    "suffix_rate": [0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9],
    "domain_rate": [0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9],
}
NAMES = list(CUTS)


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    chosen = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest if "/" in rule else "")
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    return chosen if chosen is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _lexical(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path) with a column for each feature but the rates, and the two suffixes."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    ratio = lambda c: count(c, "[0-9]") / F.greatest(F.length(c), F.lit(1))
    letters = F.split(host, "", -1)
    shares = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / F.size(letters))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.", -1)
    return df.withColumns({
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": count(path, "/[^/]"), "labels": F.when(host == "", 0).otherwise(F.size(labels)), "hyphens": count(host, "-"),
        "digit_ratio": ratio(url), "host_digit_ratio": ratio(host),
        "host_entropy": F.when(host == "", 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))),
        "params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "param_length": F.length(query),
        "fragment": F.instr(url, "#").cast("boolean").cast("int"), "secure": url.startswith("https:").cast("int"),
        "suffix": F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")),
        "domain": F.concat_ws(".", F.slice(F.reverse(F.slice(F.reverse(labels), 1, 2)), 1, 2)),
    })


SUFFIXES = ("suffix", "domain")


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")


def _rates(urls: DataFrame, key: str) -> DataFrame:
    """(key, <key>_s, <key>_n): by fold, how many labelled URLs with that suffix are blocked, and how many there are."""
    s, n = ([F.sum(F.when(F.col("fold") == i, x).otherwise(0)) for i in range(FOLDS)] for x in (F.col("label"), F.lit(1)))
    return C.save(urls.groupBy(key).agg(F.array(*s).alias(f"{key}_s"), F.array(*n).alias(f"{key}_n")), key)


def _binned(df: DataFrame, rates: dict[str, DataFrame], prior: float, own_fold: bool) -> DataFrame:
    """``df`` with a bin column for each feature. ``own_fold``: rates leave out the row's fold."""
    for key in SUFFIXES:
        df = C.lookup(df, rates[key], key, F.xxhash64("url"))
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        s, n = (F.coalesce(total(F.col(f"{key}_{x}")) - (F.col(f"{key}_{x}")[F.col("fold")] if own_fold else 0), F.lit(0)) for x in "sn")
        df = df.withColumn(f"{key}_rate", (s + PRIOR * prior) / (n + PRIOR)).drop(f"{key}_s", f"{key}_n")
    return df.withColumns({f"b_{k}": _bin(F.col(k), cuts) for k, cuts in CUTS.items()})


def _bin(value: Column, cuts: list[float]) -> Column:
    return sum(((value >= c).cast("int") for c in cuts[1:]), (value >= cuts[0]).cast("int"))


def _split(hist: list, node: int) -> tuple[str | None, int, dict]:
    """The best split of a node's histogram rows (node, feature, bin, g, h): feature, last bin to the left, sums."""
    mine: dict[int, dict[int, tuple[float, float]]] = {}
    for r in hist:
        if r["node"] == node:
            mine.setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
    if not mine:
        return None, 0, {"all": (0.0, 0.0)}
    first = mine[min(mine)]
    total = (sum(g for g, _ in first.values()), sum(h for _, h in first.values()))
    score = lambda g, h: g * g / (h + RIDGE)
    best = (1e-6, None, 0, None)
    for f in sorted(mine):
        g = h = 0.0
        for b in sorted(mine[f])[:-1]:
            g, h = g + mine[f][b][0], h + mine[f][b][1]
            gain = score(g, h) + score(total[0] - g, total[1] - h) - score(*total)
            if gain > best[0] + 1e-9:
                best = (gain, f, b, ((g, h), (total[0] - g, total[1] - h)))
    if best[1] is None:
        return None, 0, {"all": total}
    return NAMES[best[1]], best[2], {"all": total, "left": best[3][0], "right": best[3][1]}


def boost(counts: DataFrame) -> Column | None:
    """The log-odds of block as an expression over bin columns, from saved rows (bins, label, n)."""
    sums = counts.agg(F.sum(F.col("label") * F.col("n")).alias("s"), F.sum("n").alias("n")).first()
    if not sums["n"] or sums["s"] in (0, sums["n"]):
        return None
    odds = F.lit(0.0)
    even = F.when(F.col("label") == 1, sums["n"] / (2 * sums["s"])).otherwise(sums["n"] / (2 * (sums["n"] - sums["s"])))
    counts = counts.withColumn("n", F.col("n") * even)
    features = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{n}").alias("b")) for i, n in enumerate(NAMES)])
    for _ in range(TREES):
        splits: dict[int, tuple[str | None, int, dict]] = {}
        prob = 1 / (1 + F.exp(-odds))
        for level in range(DEPTH):
            node = _route(splits, 1, lambda k: F.lit(k), level)
            rows = counts.select(node.alias("node"), ((F.col("label") - prob) * F.col("n")).alias("g"), (prob * (1 - prob) * F.col("n")).alias("h"), F.explode(features).alias("x"))
            hist = rows.groupBy("node", F.col("x.f").alias("f"), F.col("x.b").alias("b")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for k in range(2**level, 2 ** (level + 1)):
                if level == 0 or splits.get(k // 2, (None,))[0]:
                    splits[k] = _split(hist, k)
        odds = odds + _route(splits, 1, lambda k, splits=splits: F.lit(_leaf(splits, k)), DEPTH)
    return odds


def _leaf(splits: dict, k: int) -> float:
    g, h = splits[k][2]["all"] if k in splits else splits[k // 2][2]["right" if k % 2 else "left"]
    return RATE * g / (h + RIDGE)


def _route(splits: dict, k: int, at, depth: int) -> Column:
    """A CASE that walks from node k down at most ``depth`` levels and ends in at(node)."""
    if depth == 0 or k not in splits or splits[k][0] is None:
        return at(k)
    return F.when(F.col(f"b_{splits[k][0]}") <= splits[k][1], _route(splits, 2 * k, at, depth - 1)).otherwise(_route(splits, 2 * k + 1, at, depth - 1))


class Trees:
    """Boosted trees fit on labelled URLs, a saved table of distinct url with lexical features, label and fold."""

    def __init__(self, urls: DataFrame):
        sums = urls.agg(F.sum("label").alias("s"), F.count("*").alias("n")).first()
        self.prior = sums["s"] / sums["n"] if sums["n"] else 0.0
        self.rates = {key: _rates(urls, key) for key in SUFFIXES}
        bins = [f"b_{k}" for k in NAMES]
        sample = _binned(urls.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS), self.rates, self.prior, own_fold=True)
        self.odds = boost(C.save(sample.groupBy(*bins, "label").agg(F.count("*").alias("n")), "bins")) if sums["n"] else None

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` with block_score, from 0 to 1."""
        binned = _binned(df, self.rates, self.prior, own_fold=False)
        return binned.withColumn("block_score", 1 / (1 + F.exp(-self.odds)) if self.odds is not None else F.lit(self.prior))


def _parsed(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Saved: all rows with features, rule hit and label; and the labelled distinct URLs."""
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = parse(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    df = _lexical(df.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)))
    df = C.save(df.withColumn("label", (F.col("hit.verdict") == "block").cast("int")), "urls")
    learned = df.filter("label is not null").drop("page_id", "hit").dropDuplicates(["url"]).withColumn("fold", _fold())
    return df, C.save(learned, "labelled")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, block_score (null where a rule decides)."""
    df, learned = _parsed(pages, id_col, url_col, rules)
    out = Trees(learned).scored(df).withColumn("block_score", F.when(F.col("hit").isNull(), F.col("block_score")))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def held_out_auc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> float | None:
    """Of trees fit on four fifths of the labelled URLs: the chance that a blocked URL of the last fifth scores above an allowed one.

    Ties count half; None without both kinds. Scores are counted by value (there are few: bounded by the leaves).
    """
    _, learned = _parsed(pages, id_col, url_col, rules)
    fifth = F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5)) == 0
    scored = Trees(C.save(learned.filter(~fifth), "fit")).scored(learned.filter(fifth))
    counts = scored.groupBy("block_score").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).orderBy("block_score").collect()
    bad, good = sum(r["bad"] for r in counts), sum(r["good"] for r in counts)
    below = wins = 0.0
    for r in counts:
        wins += r["bad"] * (below + r["good"] / 2)
        below += r["good"]
    return wins / (bad * good) if bad and good else None
