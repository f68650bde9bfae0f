"""The registered queries of this subpackage, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelyst.llm import decontaminate, divergence, language, minhash, mixing, packing, pages, quality, spelling, suffixes, tokens, toxicity, warc
from panelyst.sources.sinks import materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), scan=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash", "root")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), scan=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = materialise(decontaminate.item_sketches(_table(spark, sf_dir, "benchmark")), "items")
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), items).drop("row", "text_hash")


#: Words with A-Z in lower case, and the distinct five-word shingles of each row.
SHINGLES_SQL = """
{name}_words as (
  select {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w
  from {table} where text is not null
), {name} as (
  select distinct {id}, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as shingle
  from {name}_words
)"""

OP4_SQL = f"""
with recursive {SHINGLES_SQL.format(name="d", id="doc_id", table="documents").strip()},
n as (select doc_id, count(*) as n_shingles from d group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as common
  from d x join d y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2
), links as (
  select a, b from pairs join n p on p.doc_id = a join n q on q.doc_id = b
  where 100 * common >= 75 * (p.n_shingles + q.n_shingles - common)
), both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a
), least as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, cast(coalesce(n_shingles, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from least left join n using (doc_id)
"""

OP7_SQL = f"""
with {SHINGLES_SQL.format(name="d", id="doc_id", table="documents")},
{SHINGLES_SQL.format(name="b", id="item_id", table="benchmark")},
n as (select item_id, count(*) as n_item_shingles from b group by item_id)
select doc_id, item_id, n_item_shingles, count(*) as n_shared,
  cast(count(*) as double) / cast(n_item_shingles as double) as containment
from d join b using (shingle) join n using (item_id)
group by doc_id, item_id, n_item_shingles
having 100 * count(*) >= 75 * n_item_shingles
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("tie")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), shared_folder(spark), scan=True)


OP9_SQL = """
with p as (
  select page_id, url, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages
), f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, url, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))



def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP12_SQL = """
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), t as (
  select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), k as (
  select lang, term, count(*) as n_lang from t group by lang, term having count(distinct r) >= 10
), v as (select lang, count(*) as v, sum(n_lang) as n_all from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
n as (select lang, source, sum(n) as total from c group by lang, source),
p as (
  select lang, source, term, coalesce(n, 0) as n,
    1 + (cast(1000000000 as hugeint) * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) as p,
    1 + (cast(1000000000 as hugeint) * (n_lang + 2)) // (n_all + 2 * v) as q
  from g join k using (lang) join v using (lang) left join n using (lang, source) left join c using (lang, source, term)
), sums as (
  select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 10
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_language_id": (op3_language_id, None),
    "op4_minhash_dedup": (op4_minhash_dedup, OP4_SQL),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_html_extraction": (op6_html_extraction, None),
    "op7_decontamination": (op7_decontamination, OP7_SQL),
    "op8_mixing": (op8_mixing, None),
    "op9_warc": (op9_warc, OP9_SQL),
    "op10_toxicity": (op10_toxicity, None),
    "op11_packing": (op11_packing, None),
    "op12_source_divergence": (op12_source_divergence, OP12_SQL),
    "op13_spelling_variants": (op13_spelling_variants, None),
}
