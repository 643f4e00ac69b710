"""10. Language ID by error-correcting output codes.

Each language has a codeword; for every bit a binary classifier (logistic regression on hashed letter
1- to 3-grams of the whole text) predicts whether a text's language has that bit set. A text gets the
language whose codeword has the least loss: the sum over bits of log(1 + exp(-bit * margin)), each bit
weighted by how well its classifier did on that language in a validation fifth of the sample. Up to seven
languages get the exhaustive code (all two-way splits), more get a seeded random code of wide distance.

The model is fit on a bounded sample: SAMPLE_ROWS labelled rows at most, shared equally by the languages; if there are more
values than that (dirty labels), one row of each of the most frequent ones, ties by name. They come from documents whose crc32(doc_id as text) mod 4 is not 2. Rows are
chosen by a hash of doc_id below a threshold for each language, set by its number of rows, so that no task
ranks all rows of a language; texts are read of the chosen rows only, and one without a letter teaches
nothing. Only text is an input of a prediction. Rows are predicted where they are read; nothing is shuffled.

Of two languages with equal loss the first by name is predicted. A sample of up to SAMPLE_ROWS languages bounds what the driver
holds: SAMPLE_ROWS vectors, and codewords and classifiers that grow with the logarithm of their number.

Defined results: null text and text without a letter are ``und`` with score 0 and not ambiguous; with no
labelled row everything is. One learned language is predicted for all with score 1. Rows with a null doc_id
or null lang are never learned from; a null doc_id is not held out. Repeated rows are predicted alike, and
learned from once. Very long texts are taken whole. Ids keep their type. Only id, text and (to learn) lang
are read, whatever other columns there are. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomquery.llm import common as C
from loomquery.plans.ship import ship
from loomquery.plans.tables import sized

SAMPLE_ROWS, FEATURES = 4000, 4096
#: Languages up to which all pairs of codewords are compared to find a wide code.
PAIRED = 256
STEPS, RATE, DECAY = 150, 4.0, 1e-4
#: The two least losses nearer than this: ambiguous.
MARGIN = 0.25

_state: dict[str, np.ndarray] = {}

OUT = [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if "letter" not in _state:
        _state["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _state["letter"]


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square-rooted hashed n-gram counts; None if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(_is_letter()[points], points, 0).astype(np.uint32) if len(points) else points
    if not c.any():
        return None
    c = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # runs of other characters count as one
    one = c * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + c[1:] * np.uint32(2246822519) + np.uint32(1)
    three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(3266489917) + np.uint32(2)
    grams = np.concatenate((one, two, three))
    grams ^= grams >> np.uint32(15)
    v = np.sqrt(np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES).astype(np.float32))
    return v / np.linalg.norm(v)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1."""
    if k < 2:
        return np.zeros((k, 0), dtype=np.float32)
    if k <= 7:
        bits = [[1 if j >> i & 1 else -1 for i in range(k)] for j in range(1, 2 ** (k - 1))]
        return np.array(bits, dtype=np.float32).T.reshape(k, -1)
    rng, best, far = np.random.default_rng(7), None, -1.0
    draw = lambda: rng.choice(np.array([-1, 1], dtype=np.float32), size=(k, int(np.ceil(10 * np.log2(k)))))
    if k > PAIRED:  # drawn words of this length are far apart but for one chance in k ** 8; they are not compared
        return draw()
    for _ in range(200):
        code = draw()
        gram = code @ code.T
        np.fill_diagonal(gram, -np.inf)
        if -gram.max() > far or best is None:
            best, far = code, -gram.max()
    return best


class Model:
    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code[y]
        valid = np.arange(len(y)) % 5 == 4
        fitted = self._fit(x[~valid], bits[~valid]) if valid.any() and len(langs) > 1 else None
        hits = np.ones_like(self.code)
        if fitted is not None:
            right = (self._margins(x[valid], *fitted) > 0) == (bits[valid] > 0)
            for i in range(len(langs)):
                of = y[valid] == i
                hits[i] = (right[of].sum(axis=0) + 1) / (of.sum() + 2)
        self.weight = hits / np.maximum(hits.sum(axis=1, keepdims=True), 1e-9)
        self.w, self.b = self._fit(x, bits) if len(langs) > 1 else (np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32))

    @staticmethod
    def _margins(x, w, b):
        return x @ w + b

    @staticmethod
    def _fit(x, bits):
        """All bits' logistic regressions at once, by Nesterov's method."""
        w = np.zeros((x.shape[1], bits.shape[1]), np.float32)
        b = np.zeros(bits.shape[1], np.float32)
        mw, mb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(STEPS):
            z = bits * (x @ (w + 0.9 * mw) + b + 0.9 * mb)
            g = -bits / (1 + np.exp(np.clip(z, -30, 30))) / len(x)
            mw = 0.9 * mw - RATE * (x.T @ g + DECAY * w)
            mb = 0.9 * mb - RATE * g.sum(axis=0)
            w, b = (w + mw).astype(np.float32), (b + mb).astype(np.float32)
        return w, b

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        v = features(text) if self.langs else None
        if v is None:
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = (self.weight * np.log1p(np.exp(np.clip(-self.code * self._margins(v, self.w, self.b), -30, 30)))).sum(axis=1).astype(float)
        order = np.argsort(loss, kind="stable")
        near = np.exp(-4 * (loss - loss[order[0]]))
        return self.langs[order[0]], float(near[order[0]] / near.sum()), bool(loss[order[1]] - loss[order[0]] < MARGIN)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(known: DataFrame, rows: int) -> DataFrame:
    """(doc_id, lang) of the rows to learn from: of each language those of the least hashes of doc_id.

    A language of n rows keeps hashes below a threshold that about 2 * each + 64 rows pass, where ``each`` is
    its share; of these few the first ``each`` are taken. Of over ``rows`` languages the most frequent ones are looked at.
    """
    counts = C.save(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(rows), "languages")
    each = max(1, rows // max(1, counts.count()))
    small = counts.select("lang", (F.lit(2.0 * each + 64) / F.col("n")).alias("_lq_share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52)
    few = C.lookup(known.select("doc_id", "lang"), small, "lang", F.col("doc_id"), "inner").filter(place < F.col("_lq_share")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("doc_id", "lang")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """A model from the bounded sample; only its feature vectors (FEATURES numbers a row) come to the driver."""
    ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    chosen = known.join(sized(C.save(sample(known, rows), "sample")), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(i, w, v) for i, w, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True) if (v := features(t.as_py())) is not None]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2].tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "v"])

    # rows that repeat a doc_id count once; the order of rows decides which fifth validates, so it is fixed
    told = chosen.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").mapInArrow(vectors, "doc_id string, lang string, v binary")
    got = told.groupBy("doc_id", "lang").agg(F.min("v").alias("v")).toArrow().to_pylist()
    got.sort(key=lambda r: (zlib.crc32(r["doc_id"].encode()), r["doc_id"], r["lang"]))
    names = sorted({r["lang"] for r in got})
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[r["lang"]] for r in got], dtype=np.int64)
    x = np.array([np.frombuffer(r["v"], np.float32) for r in got], dtype=np.float32).reshape(-1, FEATURES)
    return Model(names, x, y)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, ambiguous."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *OUT])
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
