"""BM25 keyword search over an inverted index, for many queries in one plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomquery.plans.tables import save, sized, top

K1, B = 1.5, 0.75
#: Results of a query where none or zero is asked for.
TOP_K = 10
#: Documents, and pairs of a document and a query, that a task scores at most (about); tokens of queries up to which they are named to the tasks that cut texts.
DOCS, PAIRS, NAMED = 65_536, 1 << 20, 10_000
#: Stopwords that a keyword search may leave out.
STOPWORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好",
    "自己", "这", "那", "里", "为", "什么", "他", "来", "用", "能", "而", "把", "被", "从", "以", "可以", "这个", "那个", "如果", "因为", "所以", "但是", "虽然",
    "以及", "对于", "关于", "而且", "或者", "还是", "只是", "可能", "应该", "已经",
    "之后", "之前", "然后", "最后", "现在", "当时", "以后", "以前", "其中", "之间",
]


def tokenize(c: str | Column, kind: str | Callable[[Column], Column] = "words", stopwords: Iterable[str] = ()) -> Column:
    """Tokens of a text: ``words`` (lower-cased runs of letters and digits), ``words_as_written``, ``chars``, or a function of your own."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    if callable(kind):
        parts = kind(c)
    elif kind in ("words", "words_as_written"):
        parts = F.split(F.lower(c) if kind == "words" else c, r"[^\p{L}\p{N}]+")
    elif kind == "chars":
        parts = F.split(c, "")
    else:
        raise ValueError(f"unknown tokenizer {kind}")
    parts = F.filter(parts, lambda x: F.trim(x) != "")
    stop = list(stopwords)
    return F.filter(parts, lambda x: ~x.isin(stop)) if stop else parts


def segmenter(words: Iterable[str]) -> Callable[[Column], Column]:
    """A tokenizer that cuts scripts without spaces by a word list: at each place the longest word that fits, else one character.

    Runs of Latin letters and digits are tokens as they are written, case kept. For ``tokenize(..., kind=segmenter(words))``.
    """
    known = frozenset(words)
    longest = max(map(len, known), default=1)
    run = re.compile(r"[0-9A-Za-z\u00c0-\u024f]+|\w|\s+|.", re.S)

    def cut(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            plain = run.match(text, at)[0]
            if len(plain) > 1 or plain.isspace():
                out.append(plain)
                at += len(plain)
                continue
            word = next((text[at : at + n] for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in known), text[at])
            out.append(word)
            at += len(word)
        return [w for w in out if any(c.isalnum() for c in w)]

    @F.pandas_udf("array<string>")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cut(t or ""))

    return lambda c: tokens(c)


def idf(n: Column | int, df: Column, kind: str = "ratio") -> Column:
    """``ratio``: max(0, (n - df + 0.5) / (df + 0.5)); ``okapi``: ln(1 + that ratio)."""
    n = n if isinstance(n, Column) else F.lit(n)
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.greatest(F.lit(0.0), ratio) if kind == "ratio" else F.log(1 + ratio)


@dataclass
class Index:
    """postings (doc_id, token, tf), lengths (doc_id, dl), lexicon (token, df), and two totals."""

    postings: DataFrame
    lengths: DataFrame
    lexicon: DataFrame
    n: int
    avgdl: float

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind="words", stopwords: Iterable[str] = ()) -> Index:
        """Texts are cut once: each document's counted tokens are saved, and all else is read from them."""
        toks = docs.select(F.col(id_col).alias("doc_id"), tokenize(text_col, kind, stopwords).alias("tokens"))
        counted = save(_counted(toks).select("doc_id", F.size("tokens").cast("long").alias("dl"), "counts"), "counted")
        lengths = counted.select("doc_id", "dl")
        postings = counted.select("doc_id", F.explode("counts").alias("x")).select("doc_id", "x.token", "x.tf")
        lexicon = postings.groupBy("token").agg(F.count("*").alias("df"))
        return cls(postings, lengths, lexicon, *_totals(lengths))

    def write(self, path: str) -> None:
        """Postings range-partitioned by token, so that a query's tokens prune row groups."""
        self.postings.repartitionByRange("token").sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.lexicon.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/lexicon")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        postings, lengths, lexicon = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "lexicon"))
        return cls(postings, lengths, lexicon, *_totals(lengths))

    @staticmethod
    def clear(spark: SparkSession, path: str) -> bool:
        """Delete a stored index; whether there was one."""
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def add(self, other: Index) -> Index:
        """With another index of new documents: postings append, document frequencies add up."""
        lexicon = self.lexicon.unionByName(other.lexicon).groupBy("token").agg(F.sum("df").alias("df"))
        n = self.n + other.n
        avgdl = (self.avgdl * self.n + other.avgdl * other.n) / max(n, 1)
        return Index(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths), lexicon, n, avgdl)

    def terms(self, kind: str = "ratio") -> DataFrame:
        return self.lexicon.withColumn("idf", idf(self.n, F.col("df"), kind))

    def search(self, queries: DataFrame, k: int | None = None, **options) -> DataFrame:
        kind = options.pop("tokenizer", "words")
        q = query_tokens(queries, kind)
        wanted = sized(q.select("token").distinct())
        hits = self.postings.join(wanted, "token", "left_semi").join(self.lengths, "doc_id")
        return _ranked(hits, q, self.lexicon.join(wanted, "token", "left_semi"), self.n, self.avgdl, k or TOP_K, **options)


def _counted(df: DataFrame) -> DataFrame:
    """``df`` with counts, an array of (token, tf): the runs of its sorted tokens. A document's terms are counted in its row, without an exchange.

    Take the array apart by ``explode_outer``: ``explode`` adds a filter on it, which is pushed down with all
    these expressions written into each other and evaluated for every element.
    """
    runs = "transform(_at, (p, j) -> named_struct('token', _s[p], 'tf', cast(coalesce(get(_at, j + 1), size(_s)) - p as bigint)))"
    starts = "case when size(_s) = 0 then cast(array() as array<int>) else filter(sequence(0, size(_s) - 1), i -> i = 0 or _s[i] <> _s[i - 1]) end"
    return df.withColumn("_s", F.sort_array("tokens")).withColumn("_at", F.expr(starts)).withColumn("counts", F.expr(runs)).drop("_s", "_at")


def _totals(lengths: DataFrame) -> tuple[int, float]:
    r = lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("s")).first()
    return r["n"], (r["s"] or 0) / max(r["n"], 1)


def query_tokens(queries: DataFrame, kind="words") -> DataFrame:
    """(query_id, token, qtf): a token that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokenize("query", kind)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def _ranked(hits: DataFrame, q: DataFrame, lexicon: DataFrame, n: int, avgdl: float, k: int, idf_kind: str = "ratio", threshold: float | None = None, k1: float = K1, b: float = B) -> DataFrame:
    weight = F.col("qtf") * idf(n, F.col("df"), idf_kind) * F.col("tf") * (k1 + 1)
    part = weight / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(max(avgdl, 1.0)))))
    # a document's hits meet in one task before they are multiplied by queries, so that no sum of a pair is shuffled
    asked = q.select("query_id").distinct().count()
    hits = hits.repartition(max(1, -(-n // DOCS), -(-n * asked // PAIRS)), "doc_id")
    raw = hits.join(sized(lexicon.join(sized(q), "token")), "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score_raw")).filter("score_raw > 0")
    if threshold is not None:
        raw = save(raw, "scored")
        greatest = raw.groupBy(F.col("query_id").alias("_q")).agg(F.max("score_raw").alias("_m"))
        raw = raw.join(sized(greatest), F.col("query_id") == F.col("_q")).filter(F.col("score_raw") / F.col("_m") >= threshold).drop("_q", "_m")
    best = top(raw, k, ["query_id"], F.col("score_raw").desc(), F.col("doc_id"))
    most = F.max("score_raw").over(Window.partitionBy("query_id"))
    return best.select("query_id", "doc_id", F.round(F.col("score_raw") / most, 6).alias("score"), "score_raw", "rank")


def search(docs: DataFrame, queries: DataFrame, k: int | None = None, where: Column | None = None, tokenizer="words", stopwords: Iterable[str] = (), **options) -> DataFrame:
    """Top ``k`` of each query (query_id, query) without a stored index: (query_id, doc_id, score, score_raw, rank).

    One pass counts each text's terms in its row and keeps the queries' terms and one row a document (without
    a term). That table is written, before any shuffle; totals, document frequencies and scores come from it,
    so texts are read and cut once. ``where`` restricts the results, not the statistics.
    """
    k, keep = k or TOP_K, where if where is not None else F.lit(True)
    toks = docs.select("doc_id", tokenize("text", tokenizer, stopwords).alias("tokens"), F.coalesce(keep, F.lit(False)).alias("keep")).withColumn("dl", F.size("tokens").cast("long"))
    q = query_tokens(queries, tokenizer)
    named = [r["token"] for r in q.select("token").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        # other words are dropped before a text's words are sorted and counted
        toks = toks.withColumn("tokens", F.filter("tokens", lambda x: x.isin(named)))
    one = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.lit(1).cast("long").alias("tf")))
    each = _counted(toks).select("doc_id", "dl", "keep", F.explode_outer(F.concat(one, "counts")).alias("x")).select("doc_id", "dl", "keep", "x.token", "x.tf")
    wanted = sized(q.select("token").distinct().withColumn("wanted", F.lit(True)))
    hits = save(each.join(wanted, "token", "left").filter("wanted or token is null").drop("wanted"), "hits")
    totals = hits.filter("token is null").agg(F.count("*").alias("n"), F.sum("dl").alias("s")).first()
    n, avgdl = totals["n"] or 0, (totals["s"] or 0) / max(totals["n"] or 0, 1)
    found = hits.filter("token is not null")
    lexicon = found.groupBy("token").agg(F.count("*").alias("df"))
    return _ranked(found.filter("keep"), q, lexicon, n, avgdl, k, **options)


def relevant_terms(index: Index, query: str, spark: SparkSession, top_n: int = 10) -> DataFrame:
    """The query's tokens (repeats kept) by idf; unknown ones have 0."""
    q = spark.createDataFrame([(query,)], "query string").select(F.posexplode(tokenize("query")).alias("pos", "token"))
    found = q.join(index.terms(), "token", "left").select("token", F.coalesce("idf", F.lit(0.0)).alias("idf"), "pos")
    return found.orderBy(F.col("idf").desc(), "pos").limit(top_n).select("token", "idf")
