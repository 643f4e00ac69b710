"""3. Document fingerprints: SimHash with weighted terms and permuted block tables.

Terms are lower-cased words; a word of n characters weighs max(1, min(n, 12) - 2) squared, so that the
short common words of a language hardly count. Every term's 64-bit hash votes with its weight for or
against each bit; a bit is set if the votes for it outweigh those against. Votes are summed two bits to a
long (32 bits each, enough for texts of 250 MB; a text with more weight than that raises), sixteen bits to a row of
the hash aggregate.

Fingerprints within ``RADIUS`` bits are found by permuted block tables: one table for each choice of
blocks, keyed by the chosen blocks' bits and joined on the key, then verified (neardup.links, which has the
linear way for clouds of near copies). ``near_group`` is the smallest doc_id of the component; ``n_links``
counts the other rows within the radius, exactly: pairs of the block tables by a sum, those inside a cloud
without telling any pair (neardup._cloud_counts).

The edited text of a document takes the first characters of its successor. Successors are found on ids
alone; then only the needed prefix of each text moves to its predecessor. The exchange of whole texts by
key is used twice, and the votes are summed where that join leaves the rows, with no exchange of words.

Defined results: null text is the empty text, with n_chars 0 and fingerprint zero. Order is by doc_id, nulls
last, then by text hash. Rows with the same doc_id and text are one document in that order and get equal
rows. A single document is its own successor. A text whose terms weigh 2 ** 32 or more (250 MB at least) raises an
error. Only id and text are read, whatever other columns there are. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm import common as C
from loomquery.llm.graph import contracted_components
from loomquery.llm.neardup import HOT, linked

RADIUS = 4


GROUPS, LANES = 4, 8
#: Weight that the sums of a text's votes hold.
MOST = 1 << 32


def _votes() -> list[Column]:
    """Of a group of bits: 8 sums, each of bit j in its low half and bit j + 32 in its high half; and the weights."""
    pair = F.lit(0x0000000100000001)
    return [*(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(pair) * F.col("weight")).alias(f"v{j}") for j in range(LANES)), F.sum("weight").alias("all")]


def _bits() -> Column:
    half = F.lit(0xFFFFFFFF)
    low = [F.shiftleft((F.col(f"v{j}").bitwiseAND(half) > F.col("all") / 2).cast("long"), j) for j in range(LANES)]
    high = [F.shiftleft((F.shiftrightunsigned(f"v{j}", 32) > F.col("all") / 2).cast("long"), j + 32) for j in range(LANES)]
    bits = F.coalesce(reduce(lambda a, b: a.bitwiseOR(b), [*low, *high]), F.lit(0).cast("long"))
    return F.when(F.col("all") >= MOST, F.raise_error(F.lit("a text is too long to be fingerprinted")).cast("long")).otherwise(bits)


def simhash(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fp): the fingerprint of the texts that share ``keys``. Rows dealt by keys aren't dealt again.

    Each term votes on four groups of bits, a row each: 33 sums in one aggregate make code so large that
    compiling it takes more memory than the sums.
    """
    terms = texts.select(*keys, F.explode_outer(C.words(F.lower(F.col(text_col)))).alias("term"))
    size = F.greatest(F.least(F.length("term"), F.lit(12)) - 2, F.lit(1)).cast("long")
    weighed = terms.select(*keys, F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("hash"), (size * size).alias("weight"))
    group = F.explode(F.array(*[F.struct(F.lit(g * LANES).alias("shift"), F.shiftrightunsigned("hash", g * LANES).alias("h")) for g in range(GROUPS)]))
    split = weighed.select(*keys, "weight", group.alias("g")).select(*keys, "weight", "g.shift", "g.h")
    parts = split.groupBy(*keys, "shift").agg(*_votes()).select(*keys, F.expr("shift").alias("shift"), _bits().alias("bits"))
    return parts.groupBy(*keys).agg(F.bit_or(F.call_function("shiftleft", F.col("bits"), F.col("shift"))).alias("fp"))


def _hex(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def _alike(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64


def near_groups(fps: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", hot: int = HOT) -> DataFrame:
    """(fp, near_group, n_links) of each distinct fingerprint of saved rows (id, fp).

    ``n_links``: how many other rows have a fingerprint within RADIUS bits, equal ones included.
    """
    distinct = C.save(fps.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"), F.count("*").alias("w")), "distinct")
    edges, counts = linked(distinct.select("fp", "w"), distinct.count(), RADIUS, hot, count=True)
    roots = contracted_components(C.save(edges, "links"))
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").join(counts, "fp", "left")
    named = C.save(named.select("fp", "least", F.coalesce("root", "fp").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("near_group"))
    return C.save(C.spread_join(named.select("fp", "root", "n_links"), least, ["root"], F.col("fp")).select("fp", "near_group", "n_links"), "groups")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_group, n_links."""
    keys = ["k", "t"]
    rows = docs.select(F.col(id_col).alias("doc_id"), C.key_of(id_col).alias("k"), F.xxhash64(C.text_of(text_col)).alias("t"), C.text_of(text_col).alias("text"))
    digest = C.save(rows.select("doc_id", "k", "t", F.length("text").cast("long").alias("n_chars")), "digest")
    order = [F.col("doc_id").asc_nulls_last(), F.col("t")]
    ranked = C.save(C.global_scan(digest.dropDuplicates(keys), order), "order")
    n = ranked.count()
    after = ranked.select((F.col("_lq_rank") - 1).alias("_lq_rank"), F.col("k").alias("nk"), F.col("t").alias("nt"))
    after = after.withColumn("_lq_rank", F.when(F.col("_lq_rank") == 0, n).otherwise(F.col("_lq_rank")))
    pairs = C.save(ranked.join(after, "_lq_rank").select(*keys, "n_chars", "nk", "nt"), "successors")

    texts = rows.select("k", "t", "text")
    taken = F.floor(F.col("n_chars") / 2).cast("int")
    heads = texts.join(pairs.select(F.col("k").alias("pk"), F.col("t").alias("pt"), "n_chars", F.col("nk").alias("k"), F.col("nt").alias("t")), keys)
    heads = heads.select(F.col("pk").alias("k"), F.col("pt").alias("t"), F.substring("text", F.lit(1), taken).alias("head")).groupBy(*keys).agg(F.max("head").alias("head"))
    size = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), size - F.floor(size / 2).cast("int")), F.coalesce("head", F.lit("")))
    both = texts.join(heads, keys, "left").select(*keys, F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), edited.alias("text"))).alias("x"))
    each = both.select(*keys, F.unhex(F.sha2(F.col("x")[1]["text"], 256)).alias("sha"), F.explode("x").alias("x")).select(*keys, "sha", "x.kind", "x.text")
    votes = simhash(each, [*keys, "sha", "kind"])
    made = votes.groupBy(*keys).agg(F.max("sha").alias("sha"), F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    made = C.save(made, "fingerprints")

    of_next = pairs.select(*keys, F.col("nk"), F.col("nt")).join(made.select(F.col("k").alias("nk"), F.col("t").alias("nt"), F.col("fp").alias("next_fp")), ["nk", "nt"]).select(*keys, "next_fp")
    full = C.save(digest.join(made, keys).join(of_next, keys).drop(*keys), "joined")
    out = C.spread_join(full, near_groups(full), ["fp"], F.struct("doc_id", "sha"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"),
        _alike("fp", "edited_fp").alias("near_edited"), _alike("fp", "next_fp").alias("near_next"), "near_group", "n_links",
    )
