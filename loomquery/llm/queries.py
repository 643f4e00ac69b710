"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm import fingerprints, impacts, infill, langid, licenses, linededup, mixing, neardup, packing, phrases, pii, quality, urls
from loomquery.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


#: The registered query's own: pseudonyms of other tables need a secret of their owner's.
DEMO_KEY = "loomquery-demo-key"


@query
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", phrases.digest().alias("items_sha256"), "contaminated")


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = impacts.build(table(spark, sf_dir, "documents"))
    return impacts.search(index, n_docs, table(spark, sf_dir, "benchmark"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return infill.infill(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


# SQL -------------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(string_split_regex(coalesce({c}, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


def _level_sql(value: str, op: str, cuts: list[float]) -> str:
    return "(" + " + ".join(f"({value} {op} {c}::double)::int" for c in cuts) + ")"


def _op1_sql() -> str:
    chars, n = "greatest(word_chars, 1)", "greatest(n_words, 1)"
    value = {"symbols": f"n_symbols / {chars}", "repeats": f"n_repeat_words / {n}", "lines": "n_dup_lines / greatest(n_lines, 1)", "long_words": f"word_chars / {n}", "short_words": f"word_chars / {n}", "capitals": f"caps / {chars}"}
    level = f"greatest({', '.join(_level_sql(value[k], op, cuts) for k, (op, cuts) in quality.GRID.items())})"
    a = f"{quality.ALPHA}::double"
    tail = f"list_sum(list_transform(range(0, false_rejects + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({a}) + (n_good - i) * ln(1 - {a}))))"
    return rf"""
    with d as (select doc_id, coalesce('=' || lang, 'null') stratum, coalesce(text, '') text, {_WORDS.format(c="text")} w from documents),
    g as (select doc_id, i, count(*) over (partition by doc_id, x) n from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] x from d, lateral (select unnest(range(1, len(w) - 1)) i))),
    r as (select doc_id, count(distinct i + j) n_repeat_words from g, (values (0), (1), (2)) v(j) where n > 1 group by doc_id),
    l as (select doc_id, stratum, len(w) n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')) word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) n_symbols,
      length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) caps, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) lines from d),
    m as (select l.*, len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words from l left join r using (doc_id)),
    x as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, {level} level from m),
    good as (select doc_id from labels group by doc_id having min(quality) = 1 and max(quality) = 1),
    h as (select stratum, level from x semi join good using (doc_id) where not base_failed),
    k as (select {quality.DELTA}::double / (count(distinct stratum) + 1) each from h),
    s as (select stratum, case when pow(1 - {a}, count(*)) > (select each from k) then '{quality.POOL}' else stratum end tested from h group by stratum),
    c as (select tested, v.level, count(*) n_good, count(*) filter (h.level >= v.level) false_rejects from h join s using (stratum), (select unnest(range(1, {quality.LEVELS + 1})) level) v group by all),
    p as (select *, case when false_rejects > n_good * {a} then 1.0 else least(1.0, {tail}) end p_value from c),
    f as (select *, min((p_value <= (select each from k))::int) over (partition by tested order by level desc) ok from p),
    t as (select stratum, min(level)::int min_level from f join s using (tested) where ok = 1 group by stratum)
    select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed, level::int level, min_level,
      not base_failed and coalesce(level < min_level, true) kept from x left join t using (stratum)"""


def _op7_sql() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
    with d as (select doc_id, source, coalesce('=' || source, 'null') k, len({_WORDS.format(c="text")})::bigint size, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
    s as (select k, any_value(source) source, sum(size)::bigint source_size from d group by k),
    w as (select k, source_size, {mixing.CAP} * source_size cap, ([{weights}])[((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int] w from s),
    c as (select *, sum(cap) over u cc, sum(w) over u cw from w window u as (order by cap / w, k rows unbounded preceding)),
    v as (select max(({mixing.SHARE}::double * (select sum(source_size) from s) - (cc - cap)) / ((select sum(w) from w) - (cw - w))) level from c),
    t as (select k, source_size, least(cap::double, level * w) target from w, v),
    b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end copies from t),
    a as (select *, floor(target)::bigint - copies * source_size rest from b),
    r as (select k, h, z, sum(z) over (partition by k order by h) cum from (select k, h, sum(size)::bigint z from d group by all)),
    e as (select k, min(h) cut from r join a using (k) where cum > rest group by k),
    p as (select a.*, cut, (rest - (cum - z))::double left_over, z from a left join e using (k) left join r on r.k = a.k and r.h = e.cut)
    select doc_id, size, source_size, target, (copies * size + coalesce(case when h < cut then size when h = cut then floor(left_over * (size / greatest(z, 1))) else 0 end, 0))::bigint taken
    from d join p using (k)"""


_TERMS = r"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op11_sql() -> str:
    k = phrases.WINDOW
    return rf"""
    with d as (select row_number() over () r, doc_id, {_TERMS.format(c="text")} w from documents),
    b as (select distinct coalesce(item_id::varchar, 'null') item, {_TERMS.format(c="text")} w from benchmark),
    v as (select distinct item, least(len(w), {k}) n, array_to_string(w[i : i + least(len(w), {k}) - 1], ' ') x from b, lateral (select unnest(range(1, greatest(len(w) - {k - 2}, 2))) i) where len(w) > 0),
    g as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') x from d, (select distinct n from v), lateral (select unnest(range(1, len(w) - n + 2)) i)),
    f as (select r, i, n, item from g join v using (n, x)),
    h as (select r, count(distinct i + j) n_hit from (select distinct r, i, n from f), lateral (select unnest(range(0, n)) j) group by r),
    t as (select r, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct r, item from f) group by r)
    select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated
    from d left join h using (r) left join t using (r)"""


def _op12_sql(k: int = 20) -> str:
    return rf"""
    with d as (select row_number() over () r, doc_id, {_TERMS.format(c="text")} w from documents),
    z as (select count(*)::bigint big_n, sum(len(w))::bigint big_l from d where len(w) > 0),
    t as (select r, doc_id, term, n, count(*) tf from (select r, doc_id, len(w)::bigint n, unnest(w) term from d) group by all),
    q as (select item_id, term, count(*) times from (select item_id, unnest({_TERMS.format(c="text")}) term from (select distinct item_id, text from benchmark)) group by all),
    f as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint w from t, z group by term, big_n),
    s as (select item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint score from q join f using (term) join t using (term), z group by all having score > 0)
    select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int rank, doc_id, score from s qualify rank <= {k}"""


def _op13_sql() -> str:
    white = r"\x20\x09-\x0D"
    tokens = f"regexp_extract_all(text, '[{white}]*[^{white}]+|[{white}]+')"
    h = lambda i: f"('0x' || substr(sha256('{infill.SEED}:' || coalesce(doc_id::varchar, '')), {8 * i + 1}, 8))::bigint"
    part = lambda a, b: f"array_to_string(w[{a} + 1 : {b}], '')"
    return rf"""
    with d as (select doc_id, text, {tokens} w, {h(0)} h1, {h(1)} h2, {h(2)} h3, {h(3)} h4 from (select doc_id, coalesce(text, '') text from documents)),
    c as (select *, len(w)::bigint n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) b from d),
    p as (select doc_id, text, n, {part(0, "a")} pre, {part("a", "b")} mid, {part("b", "n")} suf,
      case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {infill.RATE} then 'plain' when h4 % 100 < {infill.SPM_RATE} then 'spm' else 'psm' end form from c)
    select doc_id, n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
      sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(pre || mid || suf) restored_sha256
    from p"""


ORACLES["op11_decontamination"] = _op11_sql()
ORACLES["op12_ranked_search"] = _op12_sql()
ORACLES["op13_fill_in_middle"] = _op13_sql()
ORACLES["op1_quality_rules"] = _op1_sql()
ORACLES["op7_mixing"] = _op7_sql()
