"""The registered queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import bpe, fingerprints, html_extract, langid, lm, media, mixing, near_dedup, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary file of the registered queries; the operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_columns(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents"))


ORACLES["op8_mixing"] = mixing.oracle()


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), percent=85)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_near_dedup"] = f"""
with recursive w as materialized (
  select row_number() over () as r, doc_id, {_WORDS.format(_LOWER)} as words from documents
), s as (
  select distinct r, array_to_string(list_slice(words, i, i + 4), ' ') as shingle
  from (select r, words, unnest(range(1, case when len(words) >= 5 then len(words) - 3 else 2 end)) as i from w where len(words) > 0)
), n as (
  select r, count(*) as n from s group by r
), pairs as (
  select a.r as a, b.r as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.r < b.r group by 1, 2
), links as (
  select a, b from pairs join n x on x.r = a join n y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)
), ways as (
  select a, b from links union all select b, a from links
), reached(r, root) as (
  select r, doc_id from w union select ways.b, reached.root from reached join ways on ways.a = reached.r
), least as (
  select r, min(root) as component_id from reached group by r
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from w join least using (r) left join n using (r)
"""

ORACLES["op3_substring_dedup"] = f"""
with w as materialized (
  select row_number() over () as r, doc_id, {_WORDS.format("text")} as words from documents
), windows as (
  select r, doc_id, i, list_slice(words, i, i + 12) as passage
  from (select r, doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13)
), firsts as (
  select passage, min(doc_id) as first_id from windows group by passage
), gone as (
  select distinct r, i + k as i from windows join firsts using (passage), unnest(range(13)) as t(k) where first_id < doc_id
), islands as (
  select r, count(*) as length from (select r, i - row_number() over (partition by r order by i) as island from gone) group by r, island
), stretches as (
  select r, count(*) as n_stretches, max(length) as longest from islands group by r
), tokens as (
  select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from w where len(words) > 0
), kept as (
  select r, count(*) as n, string_agg(word, ' ' order by i) as text from tokens anti join gone using (r, i) group by r
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256,
  coalesce(n_stretches, 0)::bigint as n_stretches, coalesce(longest, 0)::bigint as longest
from w left join kept using (r) left join stretches using (r)
"""
