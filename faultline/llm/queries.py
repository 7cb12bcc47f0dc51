"""Registered queries of the pipeline operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    ann,
    chatformat,
    filteraudit,
    mixing,
    packing,
    pii,
    quality,
    rules,
    sharding,
    simhash,
    suffixes,
    tokencounts,
    variants,
)
from faultline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
with docs as (
  select doc_id, source, coalesce(text, '') as text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents),
keyed as (
  select doc_id, source, size,
         -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || md5(text)), 1, 13) as bigint) + 0.5::double)
             / 4503599627370496.0::double)
         / (1.0::double - least(len(regexp_extract_all(text, '[#*$%&|<>!]'))::double / greatest(length(text), 1) * 3.75::double,
                                0.75::double)) as k
  from docs),
sources as (select source, sum(size)::bigint as source_size from keyed group by source),
weighed as (
  select *, (array[1.0, 2.0, 3.0])[((row_number() over (order by source is null, source) - 1) % 3) + 1]::double as w
  from sources),
levels as (
  select *, row_number() over o as place,
         (sum(source_size) over () - 3 * coalesce(sum(source_size) over b, 0))::double
         / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from weighed
  window o as (order by source_size::double / w, source is null, source),
         b as (order by source_size::double / w, source is null, source rows between unbounded preceding and 1 preceding)),
goals as (
  select source, source_size,
         least((3 * source_size)::double,
               w * (select arg_min(level, place) from levels where 3 * (source_size::double / w) >= level)) as target
  from levels),
cuts as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from goals),
ordered as (
  select k.*, c.source_size, c.target, c.epochs, c.target - c.epochs * c.source_size as rest,
         coalesce(sum(k.size) over (partition by k.source order by k.k, k.doc_id, k.size
                                    rows between unbounded preceding and 1 preceding), 0) as head
  from keyed k join cuts c on k.source is not distinct from c.source)
select doc_id, size::bigint as size, source_size, target,
       ((epochs + case when size > 0 and size < 2 * (rest - head) then 1 else 0 end) * size)::bigint as taken
from ordered
"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark, sf_dir):
    mixed = mixing.draw(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    """A map for one shard less is stored, edited for the shard that joins, and read back as its second version."""
    folder = shared_folder(spark, "slot-map")
    return sharding.assign(table(spark, sf_dir, "documents"), folder, grown_from=sharding.SHARDS - 1)


@query("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    judged = rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept")


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op7_pii")
def op7_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    return suffixes.dedup(table(spark, sf_dir, "documents"))


@query("op1_nearest")
def op1_nearest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    return tokencounts.counted(table(spark, sf_dir, "documents"))


AUDIT_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
judged as (
  select doc_id, part,
         (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int
         + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
  from docs),
marks as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
counts as (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as n_good, sum(coalesce(toxic, 0)) as n_toxic
  from judged left join marks using (doc_id) group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order, [p.b, q.b, r.b, s.b, t.b] as bits
  from letters p, letters q, letters r, letters s, letters t
  where p.b + q.b + r.b + s.b + t.b = 31 and p.b | q.b | r.b | s.b | t.b = 31),
places as (
  select filter_order, step::int as step, bits[step] as own,
         coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
  from orders, range(1, 6) as steps(step)),
found as (
  select part, filter_order, step, own,
         sum(case when mask & (own | earlier) = 0 then n else 0 end)::bigint as kept,
         sum(case when mask & own > 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
         sum(case when mask & own > 0 and mask & earlier > 0 then n else 0 end)::bigint as redundant,
         sum(case when mask = own then n else 0 end)::bigint as unique_fails,
         sum(case when mask & own > 0 and mask & earlier = 0 then n_good else 0 end)::bigint as good_lost,
         sum(case when mask & own > 0 and mask & earlier = 0 then n_toxic else 0 end)::bigint as toxic_lost
  from counts, places group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from found
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12_filter_audit(spark, sf_dir):
    return filteraudit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    found = variants.groups(table(spark, sf_dir, "documents"), drop_every=97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op13_chat_format")
def op13_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    extra = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")
    return chatformat.read_back(chatformat.format_chats(given.unionByName(extra)))
