"""The registered queries of the ten operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import decontam, exact, jaccard, line_dedup, mixing, quality, secrets, suffix, tokens, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("id"))


#: Target weights of the mixing tree by path (domain, language, source); what is not named weighs 1.
WEIGHTS = {("web",): 5.0, ("reference",): 3.0, ("forum",): 2.0, **{(d, lang): w for d in ("web", "reference", "forum") for lang, w in (("en", 6.0), ("de", 1.5), ("fr", 1.5), ("es", 1.0))}}


def domain(source: Column) -> Column:
    """The domain of a source by its number; sources without one belong to the web."""
    number = F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.when(number % 3 == 1, "reference").when(number % 3 == 2, "forum").otherwise("web")


def levels() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), levels(), WEIGHTS, share=0.6, max_epochs=2)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), F.col("source"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.Formats(secrets.labelled_credentials(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_format")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), with_digest=True)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_mix_sources, op2_line_dedup, op3_decontaminate, op4_quality, op5_secrets, op6_suffix_dedup, op7_extract, op8_tokens, op9_exact_dedup, op10_ngram_jaccard, pipeline)
    return {f.__name__: f for f in every}


SQL = {
    "op2_line_dedup": """
with l as (select doc_id, coalesce(source, '') as host, string_split(coalesce(text, ''), chr(10)) as ls from documents),
u as (select doc_id, host, unnest(ls) as line, generate_subscripts(ls, 1) as i from l),
n as (select host, trim(line, ' ') as k, count(distinct doc_id) as n from u where trim(line, ' ') <> '' group by 1, 2),
t as (select host, count(*) as t from l group by 1),
d as (select host, k from n join t using (host) where n >= 2 and n > t * cast(0.05 as double))
select doc_id, count(*) as n_lines, count(d.k) as n_dropped,
  coalesce(string_agg(case when d.k is null then line end, chr(10) order by i), '') as text
from u left join d on u.host = d.host and trim(u.line, ' ') = d.k group by doc_id""",
    "op3_decontaminate": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') as t from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as s from bw where len(w) > 0)),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as s from dw where len(w) > 0),
hit as (select distinct p.doc_id, p.s, x.n, win.item_id from pos p cross join (select distinct n from win) x join win on win.n = x.n and win.t = array_to_string(p.w[p.s : p.s + x.n - 1], ' ') where p.s + x.n - 1 <= len(p.w)),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(s, s + n)) as q from hit) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join covered using (doc_id) left join named using (doc_id)""",
    "op6_suffix_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, s, md5(array_to_string(w[s + 1 : s + 51], ' ')) as g from (select doc_id, w, unnest(range(greatest(len(w) - 50, 0))) as s from w)),
r as (select g from g group by g having count(distinct doc_id) > 1),
h as (select distinct doc_id, s from g semi join r using (g)),
e as (select *, case when s <= lag(s) over (partition by doc_id order by s) + 51 then 0 else 1 end as fresh from h),
i as (select *, sum(fresh) over (partition by doc_id order by s) as island from e)
select doc_id, cast(min(s) as bigint) as start_word, cast(max(s) + 51 as bigint) as end_word, cast(max(s) + 51 - min(s) as bigint) as n_words from i group by doc_id, island""",
    "op10_ngram_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) end)) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ as (select a, b from e union select b, a from e),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, both_.b from reach join both_ on both_.a = reach.r)
select reach.doc_id, cast(coalesce(any_value(n), 0) as bigint) as n_shingles, min(r) as component_id from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id""",
    "op9_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
}
