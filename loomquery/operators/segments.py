"""A stored keyword index of appended segments, searched with score bounds.

Every ``add`` writes one segment: its documents dealt into shards of bounded size by a hash of their id and numbered there
in order of id, and for each token of a shard its postings in blocks of BLOCK, each with the greatest count and the least
ratio of length to count among them, which bound what a block can add to a score under any average length. Texts are moved
once, to the task of their shard, which cuts, counts and inverts them; nothing but the segment is written. So a batch is read
three times (ids, lengths, texts) and must be the same each time.
``delete`` writes tombstones; nothing that is stored is changed. Document frequencies are sums over the segments' lexicons
less what tombstones hide, so an addition costs its own documents only. ``merge`` rewrites segments into one, without
the documents that are gone: whole shards meet in new ones, and their blocks are moved once, with new numbers. Of each version a small file in ``log`` names segments and tombstones: readers never see half a
write, and of two writers of one version the second fails.

``search`` gives the rows of ``bm25.search``. The queries' tokens choose blocks where they are stored (each file is sorted by
token); a shard's blocks meet in one task of bounded size. There, token by token from the greatest bound down, a block is read
only if some document of its range could still reach the k-th best score with all that later tokens can add; as rare tokens weigh most,
most blocks of common ones are passed by. Nothing is lost: a document that is passed by can't be among the best.

Null texts count as empty ones. A document that is added again replaces the former; of one id in a batch the first text stays. Ties go by id.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.operators import bm25
from loomquery.plans.ship import ship
from loomquery.plans.tables import save, sized, top

#: Documents of a shard, postings of a block, queries that a group scores together.
SHARD, BLOCK, QUERIES = 8192, 64, 512
#: Numbers of documents, gone ones included, that shards which meet in one by a merge have at most, in SHARDs.
SPAN = 16
#: Tokens up to which a search names them to the scan.
NAMED = 2000
#: Scores this near count as equal: they are rounded to six places.
SLACK = 2e-6

POSTINGS = "array<struct<ord: int, tf: int, dl: int>>"
_BLOCKS = f"""
transform(sequence(0, cast(ceil(size(ps) / {BLOCK}) as int) - 1), b -> struct(b as block, slice(ps, b * {BLOCK} + 1, {BLOCK}) as ps))
"""


class SegmentedIndex:
    """Under ``path``: ``docs`` (shard, ord, doc_id, dl), ``blocks``, ``lexicon`` (token, df) and ``gone`` (seg, shard, ord, dl) by segment, and ``log``."""

    def __init__(self, spark: SparkSession, path: str, tokenizer="words", stopwords: Iterable[str] = ()):
        self.spark, self.path, self.tokenizer, self.stopwords = spark, path.rstrip("/"), tokenizer, list(stopwords)

    def _fs(self, path: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        p, fs = self._fs("/log")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if re.fullmatch(r"\d+\.json", s.getPath().getName())) if fs.exists(p) else []

    def about(self) -> dict:
        """The latest version: segments (name to number of documents and of tokens) and tombstones (name to the same)."""
        have = self._versions()
        if not have:
            return {"segments": {}, "gone": {}}
        p, fs = self._fs(f"/log/{have[-1]}.json")
        opened = fs.open(p)
        try:
            return json.loads(bytes(opened.readAllBytes()).decode())
        finally:
            opened.close()

    def _commit(self, about: dict) -> None:
        have = self._versions()
        p, fs = self._fs(f"/log/{have[-1] + 1 if have else 0}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()

    def _read(self, kind: str, names: Iterable[str] | None = None) -> DataFrame | None:
        """A kind's rows of some or all segments, with the segment's name as ``seg``; None without any."""
        names = list(self.about()["gone" if kind == "gone" else "segments"] if names is None else names)
        if not names:
            return None
        column = "at" if kind == "gone" else "seg"
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(self._schema(kind)).parquet(*[f"{self.path}/{kind}/{column}={n}" for n in names])

    def _schema(self, kind: str) -> str:
        id_type = self.about().get("id", "string")
        return {
            "docs": f"shard int, ord int, doc_id {id_type}, dl int, seg string", "lexicon": "token string, df long, seg string", "gone": "seg string, shard int, ord int, dl int, at string",
            "blocks": f"shard int, token string, block int, lo int, hi int, most int, least double, ps {POSTINGS}, seg string",
        }[kind]

    def _live(self, names: Iterable[str] | None = None) -> DataFrame | None:
        """The documents that no tombstone hides."""
        docs, gone = self._read("docs", names), self._read("gone")
        return docs if docs is None or gone is None else docs.join(sized(gone.select("seg", "shard", "ord")), ["seg", "shard", "ord"], "left_anti")

    def _name(self) -> str:
        return f"{(self._versions() or [-1])[-1] + 1:010d}-{uuid.uuid4().hex}"

    def _write(self, docs: DataFrame, lists: DataFrame) -> tuple[str, dict]:
        """A segment of documents (shard, ord, doc_id, dl) and lists (shard, token, ps), a shard in one task: its name, and what it holds."""
        name = self._name()
        docs.select("shard", F.col("ord").cast("int").alias("ord"), "doc_id", F.col("dl").cast("int").alias("dl")).write.parquet(f"{self.path}/docs/seg={name}")
        blocks = lists.select("shard", "token", F.explode(F.expr(_BLOCKS)).alias("b")).select("shard", "token", "b.block", F.col("b.ps").alias("ps"))
        lo, hi = F.col("ps")[0]["ord"].alias("lo"), F.element_at("ps", -1)["ord"].alias("hi")
        most, least = F.array_max("ps.tf").alias("most"), F.array_min(F.transform("ps", lambda p: p["dl"] / p["tf"])).alias("least")
        told = blocks.select("shard", "token", "block", lo, hi, most, least, "ps")
        told.sortWithinPartitions("token", "shard", "block").write.parquet(f"{self.path}/blocks/seg={name}")
        df = self._read("blocks", [name]).groupBy("token").agg(F.sum(F.size("ps.ord")).alias("df"))
        df.sortWithinPartitions("token").write.parquet(f"{self.path}/lexicon/seg={name}")
        total = self._read("docs", [name]).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        return name, {"n": total["n"], "words": total["words"]}

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """A segment of new documents, in place of those that have their ids; the number added."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
        ids = save(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "ids")
        n, repeated = ids.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
        if repeated:
            # only texts of ids that come again are compared
            again = sized(ids.filter("n > 1").select("doc_id"))
            rows = rows.join(again, "doc_id", "left_anti").unionByName(top(rows.join(again, "doc_id", "left_semi"), 1, ["doc_id"], F.col("text"), rank="_n").drop("_n"))
        gone = self._bury(ids.select("doc_id"))
        shards, tokens = max(1, -(-n // SHARD)), bm25.tokenize("text", self.tokenizer, self.stopwords)
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
        ord_ = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")) - 1
        placed = dealt.repartitionById(shards, F.col("shard")).withColumn("ord", ord_).select("shard", "ord", tokens.alias("tokens"))
        each = bm25._counted(placed).select("shard", "ord", F.size("tokens").alias("dl"), F.explode_outer("counts").alias("x")).filter("x is not null")
        posting = F.struct(F.col("ord").cast("int").alias("ord"), F.col("x.tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
        lists = each.groupBy("shard", F.col("x.token").alias("token")).agg(F.sort_array(F.collect_list(posting)).alias("ps"))
        name, holds = self._write(dealt.select("shard", "doc_id", F.size(tokens).alias("dl")).withColumn("ord", ord_), lists)
        about = self.about()
        about["id"] = rows.schema["doc_id"].dataType.simpleString()
        about["segments"][name] = holds
        about["gone"] |= gone
        self._commit(about)
        return holds["n"]

    def _bury(self, ids: DataFrame) -> dict:
        """Tombstones of the live documents with these ids: their name and what they hide; nothing if there are none."""
        live = self._live()
        if live is None:
            return {}
        found = save(live.join(sized(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("seg", "shard", "ord", "dl"), "gone")
        total = found.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
        if not total["n"]:
            return {}
        name = self._name()
        found.write.parquet(f"{self.path}/gone/at={name}")
        return {name: {"n": total["n"], "words": total["words"]}}

    def delete(self, ids: DataFrame) -> int:
        """Hide the documents with these ids (doc_id); how many there were."""
        gone = self._bury(ids)
        if gone:
            about = self.about()
            about["gone"] |= gone
            self._commit(about)
        return sum(x["n"] for x in gone.values())

    def merge(self, below: int | None = None) -> int:
        """Rewrite the segments of under ``below`` documents (all unless given) into one without what is gone; how many were merged.

        Tombstones stay until every segment is merged.
        """
        about = self.about()
        names = [n for n, x in about["segments"].items() if below is None or x["n"] < below]
        if len(names) < 2 and not (names and about["gone"]):
            return 0
        name, holds = self._write(*self._moved(names))
        rest = {n: x for n, x in about["segments"].items() if n not in names}
        gone = {}
        if rest and about["gone"]:
            left = save(self._read("gone").filter(F.col("seg").isin(list(rest))).select("seg", "shard", "ord", "dl"), "gone")
            total = left.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
            if total["n"]:
                left.write.parquet(f"{self.path}/gone/at={name}")
                gone = {name: {"n": total["n"], "words": total["words"]}}
        self._commit({**about, "segments": rest | {name: holds}, "gone": gone})
        return len(names)

    def _moved(self, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """What is live in these segments, as documents and lists of new shards. Each of the old shards goes to one of them."""
        docs, gone = self._read("docs", names), self._read("gone")
        dead = F.lit(None).cast("boolean")
        if gone is not None:
            docs, dead = docs.join(sized(gone.select("seg", "shard", "ord", F.lit(True).alias("dead"))), ["seg", "shard", "ord"], "left"), F.col("dead")
        docs = docs.withColumn("dead", F.coalesce(dead, F.lit(False)))
        sizes = docs.groupBy("seg", "shard").agg(F.count_if(~F.col("dead")).alias("n"), (F.max("ord") + 1).alias("span")).filter("n > 0").orderBy("seg", "shard").collect()
        moves, to, held, base = [], 0, 0, 0
        for x in sizes:
            if held and (held + x["n"] > SHARD or base + x["span"] > SPAN * SHARD):
                to, held, base = to + 1, 0, 0
            moves.append((x["seg"], x["shard"], to, base))
            held, base = held + x["n"], base + x["span"]
        moves = sized(self.spark.createDataFrame(moves, "seg string, shard int, to int, base int"))
        # of a document, its place among all of its new shard's old numbers, and its new number (null if it is gone)
        number = F.row_number().over(Window.partitionBy("to", "dead").orderBy("doc_id")) - 1
        placed = docs.join(moves, ["seg", "shard"]).select("to", (F.col("base") + F.col("ord")).alias("place"), F.when(~F.col("dead"), number).alias("ord"), "doc_id", "dl")
        placed = save(placed, "placed")
        numbers = placed.groupBy("to").agg(F.sort_array(F.collect_list(F.struct("place", "ord")))["ord"].alias("numbers"))
        blocks = self._read("blocks", names).join(moves, ["seg", "shard"]).select("to", "token", "base", "ps").join(numbers, "to")
        kept = F.filter(F.transform("ps", lambda p: F.struct(F.get("numbers", F.col("base") + p["ord"]).alias("ord"), p["tf"].alias("tf"), p["dl"].alias("dl"))), lambda p: p["ord"].isNotNull())
        parts = blocks.select(F.col("to").alias("shard"), "token", kept.alias("ps")).filter(F.size("ps") > 0)
        lists = parts.groupBy("shard", "token").agg(F.sort_array(F.flatten(F.collect_list("ps"))).alias("ps"))
        return placed.filter("ord is not null").select(F.col("to").alias("shard"), "ord", "doc_id", "dl"), lists

    def clear(self) -> bool:
        p, fs = self._fs()
        return fs.delete(p, True)

    def totals(self) -> tuple[int, float]:
        """Live documents and their mean length."""
        about = self.about()
        n, words = (sum(x[k] for x in about["segments"].values()) - sum(x[k] for x in about["gone"].values()) for k in ("n", "words"))
        return n, words / max(n, 1)

    def lexicon(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, df) of live documents, of all tokens or of some: segments' sums, less what tombstones hide."""
        df, gone = self._read("lexicon"), self._read("gone")
        if df is None:
            return self.spark.createDataFrame([], "token string, df long")
        chosen = lambda x: x if tokens is None else x.join(sized(tokens), "token", "left_semi")
        total = chosen(df.select("token", "df"))
        if gone is not None:
            # only segments with tombstones are looked into
            hit = [r["seg"] for r in gone.select("seg").distinct().collect()]
            hidden = chosen(self._read("blocks", hit)).select("seg", "shard", "token", F.explode("ps.ord").alias("ord")).join(sized(gone.select("seg", "shard", "ord")), ["seg", "shard", "ord"], "left_semi")
            total = total.unionByName(hidden.select("token", F.lit(-1).cast("long").alias("df")))
        return total.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")

    def terms(self, kind: str = "ratio") -> DataFrame:
        return self.lexicon().withColumn("idf", bm25.idf(self.totals()[0], F.col("df"), kind))

    def search(self, queries: DataFrame, k: int | None = None, idf_kind: str = "ratio", threshold: float | None = None, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        """(query_id, doc_id, score, score_raw, rank): the best ``k`` of each query (query_id, query)."""
        return self.search_counted(queries, k, idf_kind, threshold, k1, b)[0]

    def search_counted(self, queries: DataFrame, k: int | None = None, idf_kind: str = "ratio", threshold: float | None = None, k1: float = bm25.K1, b: float = bm25.B) -> tuple[DataFrame, DataFrame]:
        """The results of ``search``, and (query_id, blocks, blocks_read): of a query's tokens, all blocks and those that were read."""
        k, (n, avgdl) = k or bm25.TOP_K, self.totals()
        q = save(bm25.query_tokens(queries, self.tokenizer), "tokens")
        vocabulary = save(q.select("token").distinct(), "vocabulary")
        id_type, doc_type = queries.schema["query_id"], T.StructField("doc_id", T._parse_datatype_string(self.about().get("id", "string")))
        blocks = self._read("blocks")
        if blocks is None:
            counts = T.StructType([id_type, T.StructField("blocks", T.LongType()), T.StructField("blocks_read", T.LongType())])
            columns = [id_type, doc_type, T.StructField("score", T.DoubleType()), T.StructField("score_raw", T.DoubleType()), T.StructField("rank", T.IntegerType())]
            return self.spark.createDataFrame([], T.StructType(columns)), self.spark.createDataFrame([], counts)
        named = vocabulary.limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            blocks = blocks.filter(F.col("token").isin([r["token"] for r in named]))
        weighed = q.join(sized(self.lexicon(vocabulary)), "token").withColumn("w", F.col("qtf") * bm25.idf(n, F.col("df"), idf_kind)).filter("w > 0")
        turns = max(1, -(-queries.count() // QUERIES))
        turn = F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("turn")
        uses = save(weighed.groupBy("token", turn).agg(F.collect_list(F.struct("query_id", "w")).alias("uses")), "uses")
        held = blocks.join(sized(uses.select("token", "turn")), "token")
        right = held.select("seg", "shard", "turn", "token").distinct().join(sized(uses), ["token", "turn"]).withColumn("dead", F.lit(None).cast("array<int>"))
        gone = self._read("gone")
        if gone is not None:
            dead = gone.groupBy("seg", "shard").agg(F.collect_list("ord").alias("dead")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
            right = right.unionByName(dead, allowMissingColumns=True)
        right = save(right, "uses")
        schema = T.StructType([id_type, T.StructField("seg", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("ord", T.IntegerType())])
        schema = schema.add("score_raw", T.DoubleType()).add("blocks", T.LongType()).add("blocks_read", T.LongType())
        ship(self.spark)
        key = ["seg", "shard", "turn"]
        met = held.select(*key, "token", "lo", "hi", "most", "least", "ps").groupBy(*key).cogroup(right.groupBy(*key))
        told = save(met.applyInArrow(_scorer(k, k1, b, max(avgdl, 1.0), schema), schema), "found")
        found = told.filter("ord is not null").select("query_id", "seg", "shard", "ord", "score_raw")
        docs = self._read("docs").select("seg", "shard", "ord", "doc_id").join(sized(found), ["seg", "shard", "ord"])
        best = top(docs, k, ["query_id"], F.col("score_raw").desc(), F.col("doc_id"))
        share = F.round(F.col("score_raw") / F.max("score_raw").over(Window.partitionBy("query_id")), 6)
        out = best.withColumn("_s", F.col("score_raw") / F.max("score_raw").over(Window.partitionBy("query_id"))).withColumn("score", share)
        out = out if threshold is None else out.filter(F.col("_s") >= threshold)
        read = told.filter("ord is null").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("blocks_read").alias("blocks_read"))
        return out.select("query_id", "doc_id", "score", "score_raw", "rank"), read


class _List:
    """The blocks of a token in a shard."""

    def __init__(self, lo, hi, bound, start, end):
        self.lo, self.hi, self.bound, self.start, self.end = lo, hi, bound, start, end
        self.cuts = np.stack((lo, hi + 1), axis=1).ravel()


def best_of_shard(lists: list[tuple[float, _List]], part, docs: int, dead: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of the ``k`` best (and those that tie), and how many blocks were read.

    ``lists`` are (weight, blocks) of a query; ``part`` gives documents and unweighted score parts of postings.
    """
    lists = sorted(lists, key=lambda x: -x[0] * float(x[1].bound.max()))
    later = np.append(np.cumsum([w * float(x.bound.max()) for w, x in lists][::-1])[::-1], 0.0)
    total, least, read = np.zeros(docs + 1), 0.0, 0
    total[dead[dead < docs]] = -np.inf
    total[docs] = -np.inf
    for turn, (w, x) in enumerate(lists):
        reach = np.maximum.reduceat(total, x.cuts)[::2] + w * x.bound + later[turn + 1]
        need = np.flatnonzero(reach >= least - SLACK) if least else np.arange(len(x.lo))
        read += len(need)
        n = x.end[need] - x.start[need]
        at = np.repeat(x.start[need] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        where, value = part(at)
        total[where] += w * value
        if docs >= k:
            least = max(0.0, float(np.partition(total[:docs], docs - k)[docs - k]))
    found = np.flatnonzero(total[:docs] > max(0.0, least - SLACK))
    return found, total[found], read


def _scorer(k: int, k1: float, b: float, avgdl: float, schema: T.StructType):
    """Of a shard's blocks and the queries that use their tokens: the best documents, and a row of counts for each query."""

    def run(blocks, uses):
        import pyarrow as pa

        rows, names = [], schema.names
        if blocks.num_rows:
            blocks = blocks.sort_by([("token", "ascending"), ("lo", "ascending")]).combine_chunks()
            ps = blocks.column("ps").combine_chunks()
            postings, sizes = ps.flatten(), np.asarray(ps.value_lengths())
            ord_, tf, dl = (np.asarray(postings.field(f)) for f in ("ord", "tf", "dl"))
            ends = np.cumsum(sizes)
            lo, hi, most, least = (np.asarray(blocks.column(c)) for c in ("lo", "hi", "most", "least"))
            bound = (k1 + 1) / (1 + k1 * (1 - b) / most + k1 * b * least / avgdl)

            def part(at):
                t = tf[at].astype(float)
                return ord_[at], t * (k1 + 1) / (t + k1 * (1 - b + b * dl[at] / avgdl))

            tokens, places = blocks.column("token").to_pylist(), {}
            for i, token in enumerate(tokens):
                places.setdefault(token, []).append(i)
            lists = {t: _List(lo[i], hi[i], bound[i], (ends - sizes)[i], ends[i]) for t, i in places.items()}
            asked, dead = {}, np.zeros(0, np.int64)
            for use in uses.select(["token", "uses", "dead"]).to_pylist():
                if use["dead"] is not None:
                    dead = np.append(dead, np.array(use["dead"], dtype=np.int64))
                for u in use["uses"] or ():
                    asked.setdefault(u["query_id"], []).append((u["w"], lists[use["token"]]))
            seg, shard, docs = blocks.column("seg")[0].as_py(), blocks.column("shard")[0].as_py(), int(hi.max()) + 1
            for query, own in asked.items():
                found, score, read = best_of_shard(own, part, docs, dead, k)
                order = np.lexsort((found, -np.round(score, 6)))[:k]
                rows += [(query, seg, shard, int(found[i]), round(float(score[i]), 6), None, None) for i in order if round(float(score[i]), 6) > 0]
                rows.append((query, seg, shard, None, None, sum(len(x.lo) for _, x in own), read))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        kinds = [uses.schema.field("uses").type.value_type.field("query_id").type, pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run
