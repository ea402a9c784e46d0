"""Queries of this subpackage: opN_<name>(spark, sf_dir), and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, fingerprints, licenses, mixing, quality, secrets, sharding
from .filter_audit import text_filter_interaction
from .near_dedup import near_duplicates
from .packing import pack
from .simhash import simhash_components
from .spelling import counted_words, spelling_variants
from .substring_dedup import substring_dedup
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=13)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Production parameters of the sharding query.
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(64)], 65537


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id"), SHARDS, SLOTS).select("doc_id", "slot", "shard")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(counted_words(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_filter_interaction(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_sharding, op3_packing, op4_toxicity, op5_secrets, op6_quality, op7_mixing, op8_near_dedup, op9_fingerprints, op10_licenses,
        op11_simhash, op12_spelling, op13_filter_audit,
    )
}

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"



def _sharding_sql() -> str:
    """The table in SQL: in turn t, shard t modulo their number claims a slot.

    The claims depend on each other one by one, so the filled table stands in the SQL as a list.
    """
    filled = ",".join(map(str, sharding.fill_table(SHARDS, SLOTS)))
    return f"""
        with t as (select string_split('{filled}', ',') as slots)
        select doc_id, slot, printf('shard-%02d', slots[slot + 1]::int) as shard
        from (select doc_id, ('0x' || md5(coalesce(doc_id::varchar, ''))[1:8])::bigint % {SLOTS} as slot from documents), t"""


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return f"""
        with d as (select doc_id, {WORDS} as w, coalesce(text, '') as t, [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as lines from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
        twice as (select doc_id, k from win group by doc_id, k having count(*) > 1),
        hit as (select doc_id, unnest([i, i + 1, i + 2]) as j from win join twice using (doc_id, k)),
        rep as (select doc_id, count(distinct j) as n_repeat_words from hit group by doc_id),
        m as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
                     len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                     coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len([x for x in w if x in ({stop})])::bigint as n_stop_words, len(lines)::bigint as n_lines
              from d left join rep using (doc_id))
        select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars / n_words between 2 and 12 and n_symbols / n_words <= 0.1
               and n_stop_words / n_words >= 0.02 and n_dup_lines / greatest(n_lines, 1) <= 0.4 as kept
        from m"""


MIXING_SQL = """
    with d as (select doc_id, source, len(coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []))::bigint as size, coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) as name from documents),
    s as (select source, sum(size)::bigint as source_size from d group by source),
    w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, 3 * source_size as bound from s),
    l as (select *, bound / weight as ratio,
                 ((select sum(source_size)::bigint from s) - coalesce(sum(bound) over before, 0)::bigint) / ((select sum(weight)::bigint from w) - coalesce(sum(weight) over before, 0)::bigint) as level
          from w window before as (order by bound / weight, source nulls last rows between unbounded preceding and 1 preceding)),
    f as (select *, ratio < level as is_full from l),
    e as (select source, source_size, case when is_full then bound::double
                 else weight * (((select sum(source_size)::bigint from s) - coalesce((select sum(bound)::bigint from f where is_full), 0)) / (select sum(weight)::bigint from f where not is_full)) end as target from f),
    x as (select *, coalesce(target / nullif(source_size, 0), 0.0) as expected from e),
    y as (select *, floor(expected)::bigint as whole, expected - floor(expected) as fraction, target - floor(expected)::bigint * source_size as rest from x),
    u as (select d.doc_id, d.source, d.size, d.name, source_size, target, whole, fraction, rest,
                 (('0x' || md5('0:' || d.name)[1:13])::bigint::double + 0.5) / 4503599627370496.0 as u
          from d join y on d.source is not distinct from y.source),
    r as (select *, (u / (1 - u)) / (fraction / (1 - fraction)) as rank from u),
    c as (select *, coalesce(sum(size) over (partition by source order by rank, name rows between unbounded preceding and 1 preceding), 0)::bigint as before from r)
    select doc_id, size, source_size, target, ((whole + case when fraction > 0 and 2 * before + size <= 2 * rest then 1 else 0 end) * size)::bigint as taken from c"""


def _licenses_sql() -> str:
    """Sentences by splitting, identifiers by a join, rules as nested positions."""
    known = ", ".join(f"('{licenses.normalised_text(s.replace('#', '0'))}', '{name}')" for name, s in licenses.SENTENCES.items())
    ends = licenses.ENDS.replace(r"(?=[\x20\x09-\x0D]|$)|\n", r"([\x20\x09-\x0D]|$)|\n")
    rules = []
    for rule in licenses.RULES:
        at = "0"
        for name in rule.sentences:
            place = f"list_position(ids[({at}) + 1:], '{name}')"
            at = f"({at}) + nullif({place}, 0)"
        without = "".join(f" and not list_contains(ids, '{name}')" for name in rule.without)
        rules.append(f"case when ({at}) > 0{without} then '{rule.licence}' end")
    return f"""
        with k(sentence, id) as (values {known}),
        d as (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{ends}')) as part, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '{ends}'), 1) as i from documents),
        n as (select doc_id, i, trim(regexp_replace(regexp_replace(lower(part), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g')) as sentence from d),
        h as (select doc_id, list(id order by i) as found from n join k using (sentence) group by doc_id),
        a as (select doc_id, coalesce(found, []) as ids from documents left join h using (doc_id))
        select doc_id, array_to_string(ids, ',') as sentence_ids, array_to_string(list_sort(list_distinct([x for x in [{", ".join(rules)}] if x is not null])), ',') as licences, len(ids)::bigint as n_sentences from a"""


SPELLING_SQL = r"""
    with recursive codes as (select list(c order by i) as t from (select i, list_reduce([i] || [0 for _ in range(8)], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
    runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{6,}')) as run from documents),
    low as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by all),
    hexed as (select run, n, hex(encode(id || ':' || run)) as x from low),
    bytes as (select run, n, [4294967295] || [('0x' || x[2 * i - 1:2 * i])::bigint for i in range(1, length(x) // 2 + 1)] as b from hexed),
    hashed as (select run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, codes),
    made as (select case when h % 199 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed),
    w as (select word, sum(n)::bigint as n from made where length(word) >= 6 group by word having sum(n) >= 5),
    cut as (select word, n, i, left(word, i - 1) || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
    pairs as (select a.word, b.word as other from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
              union select cut.word, w.word from cut join w on w.word = rest union select w.word, cut.word from cut join w on w.word = rest),
    near as (select p.word, other, w.n as other_n from pairs p join w on w.word = other),
    best as (select word, count(*) as n_near, first(other order by other_n desc, encode(other)) as form, max(other_n) as form_n from near group by word),
    f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 5 * w.n then form end as form, case when form_n >= 5 * w.n then form_n end as form_n from w left join best using (word)),
    up(word, place) as (select word, word from f union all select up.word, f.form from up join f on up.place = f.word where f.form is not null),
    top as (select up.word, up.place as root from up join f on up.place = f.word where f.form is null)
    select word, form, root, n, n_near, form_n from f join top using (word)"""


def _audit_sql() -> str:
    """Every order applied step by step: the filters before a step stand as a set of bits."""
    steps = ", ".join(f"('{order}', {step}, {state}, {1 << f}, '{'ABCDE'[f]}')" for order, step, state, f in filter_audit.order_steps("ABCDE"))
    return f"""
        with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {WORDS} as w from documents),
        marked as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
        c as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::int
                     + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic
              from d left join marked using (doc_id)),
        s(filter_order, step, state, bit, name) as (values {steps}),
        r as (select part, filter_order, step, name, count(*) filter (mask & (state | bit) = 0) as kept, count(*) filter (mask & state = 0 and mask & bit > 0) as removed,
                     count(*) filter (mask & state > 0 and mask & bit > 0) as redundant, count(*) filter (mask = bit) as unique_fails,
                     count(*) filter (mask & state = 0 and mask & bit > 0 and good) as good_lost, count(*) filter (mask & state = 0 and mask & bit > 0 and toxic) as toxic_lost
              from c, s group by all)
        select * exclude (name), (sum(removed) over (partition by part, name))::bigint as shapley from r"""


ORACLE_SQL = {
    "op1_substring_dedup": f"""
        with d as (select doc_id, {WORDS} as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
        least as (select k, min(doc_id) as first from win group by k),
        hit as (select doc_id, i from win join least using (k) where first < doc_id),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from hit),
        lost as (select doc_id, list(j) as js from gone group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, coalesce(len(js), 0)::bigint as n_removed,
               sha256(case when js is null then array_to_string(w, ' ') else array_to_string([x for x, j in w if not list_contains(js, j)], ' ') end) as kept_sha256
        from d left join lost using (doc_id)""",
    "op2_sharding": _sharding_sql(),
    "op6_quality": _quality_sql(),
    "op7_mixing": MIXING_SQL,
    "op10_licenses": _licenses_sql(),
    "op12_spelling": SPELLING_SQL,
    "op13_filter_audit": _audit_sql(),
}
