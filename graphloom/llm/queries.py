"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, context_mixing, dialogue_repair, icws, licenses, merkle, mixing, outliers, page_diff, ppm, token_align, token_files, vector_passes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; another path may be passed to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _damaged(records: DataFrame) -> DataFrame:
    """A replica with planted damage: the last character of every 199th page is overwritten, and of
    every third segment one record is lost."""
    body = F.when(F.col("record_id") % 199 == 7, F.concat(F.expr("left(body, length(body) - 5)"), F.lit("~"), F.expr("right(body, 4)"))).otherwise(F.col("body"))
    lost = (F.expr("record_id div 1000") % 3 == 0) & (F.col("record_id") % 1000 == 240)
    return records.filter(~F.coalesce(lost, F.lit(False))).withColumn("body", body)


@_query
def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = merkle.warc_records(_table(spark, sf_dir, "pages"))
    return merkle.audit(merkle.tree(records), merkle.tree(_damaged(records)))


ORACLES["op1_merkle_audit"] = """
with records as (
  select 'segment-' || lpad(cast(page_id // 1000 as varchar), 9, '0') || '.warc' as file, page_id as record_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) || chr(10) as body
  from pages),
replica as (
  select file, record_id, case when record_id % 199 = 7 then left(body, length(body) - 5) || '~' || right(body, 4) else body end as body
  from records where not (record_id // 1000 % 3 = 0 and record_id % 1000 = 240)),
ours as (select *, sum(strlen(body)) over (partition by file order by record_id) - strlen(body) as at from records),
theirs as (select *, sum(strlen(body)) over (partition by file order by record_id) - strlen(body) as at from replica)
select coalesce(a.file, b.file) as file, coalesce(a.record_id, b.record_id) as record_id,
       case when b.file is null then 'missing' when a.file is null then 'extra' when a.body <> b.body then 'corrupt' else 'moved' end as kind,
       cast(coalesce(a.at, b.at) as bigint) as "offset", cast(strlen(coalesce(a.body, b.body)) as bigint) as length
from ours a full join theirs b on a.file = b.file and a.record_id = b.record_id
where a.file is null or b.file is null or a.body <> b.body or a.at <> b.at
"""


@_query
def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"({i}, '{label}', {quoted(sorted(set(text.split(' '))))})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({quoted(text.split(' '))}, '{label}')" for text, label in licenses.PHRASES.items())
    return f"""
with templates(template, label, tokens) as (values {templates}),
phrases(p, plabel) as (values {phrases}),
spaced as (
  select doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) as t from documents),
texts as (select doc_id, case when t = '' then [] else string_split(t, ' ') end as w from spaced),
places as (
  select doc_id, plabel, i as place
  from texts, phrases, unnest(range(len(w) - len(p) + 1)) as u(i) where w[i + 1] = p[1] and w[i + 1 : i + len(p)] = p),
base as (
  select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct plabel) as base from places group by doc_id),
blocks as (select doc_id, list_distinct(w[{licenses.STEP} * i + 1 : {licenses.STEP} * i + {licenses.BLOCK}]) as held
           from texts, unnest(range(0, (len(w) + {licenses.STEP - 1}) // {licenses.STEP})) as u(i)),
matched as (
  select doc_id, label, len(list_intersect(tokens, held)) / len(tokens) as containment from blocks, templates
  where len(list_intersect(tokens, held)) >= {licenses.THRESHOLD} * len(tokens) - 1e-9),
found as (select doc_id, list(distinct label) as found, max(containment) as best from matched group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from texts t left join base b on t.doc_id = b.doc_id left join found f on t.doc_id = f.doc_id
"""


ORACLES["op3_license_scan"] = _license_sql()


@_query
def op4_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@_query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op7_embedding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_passes.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLES["op7_embedding_passes"] = """
with recursive valid as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from valid a join valid b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
smallest as (select a, min(b) as component_id from reach group by a),
counted as (select a, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join smallest s on e.vec_id = s.a left join counted c on e.vec_id = c.a
"""


@_query
def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


@_query
def op9_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(_table(spark, sf_dir, "pages"))


@_query
def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(_table(spark, sf_dir, "documents"))


@_query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.alignment(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return dialogue_repair.repair(dialogue_repair.damaged(rows), rows)
