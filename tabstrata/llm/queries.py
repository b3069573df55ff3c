"""The registered queries of this package, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstrata.llm import (
    decontaminate,
    jaccard_join,
    language_id,
    lattice_lm,
    license_scan,
    line_dedup,
    mixing,
    sharding,
    spelling,
    token_alignment,
    token_counts,
    topk_search,
    toxicity,
)
from tabstrata.llm.common import crc_mod
from tabstrata.runtime import materialize

_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select(F.col("vec_id").alias("id"), topk_search.sign_code(F.col("embedding"), 64).alias("code"))
    return topk_search.top_k(codes, codes.where("id % 20 = 0"), k=10, bits=64)


_BITS = " + ".join(f"(case when embedding[{i + 1}] >= 0 then {1 << i}::ubigint else 0::ubigint end)" for i in range(64))
_SQL["op1_exact_top_k_search"] = f"""
with codes as (select distinct vec_id as id, {_BITS} as code from embeddings where embedding is not null
), near as (
  select q.id as query_id, c.id as neighbour_id, bit_count(xor(q.code, c.code))::bigint as distance
  from codes q join codes c on q.id % 20 = 0 and q.id != c.id
)
select query_id, rank, neighbour_id, distance
from (select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank from near)
where rank <= 10
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL["op2_benchmark_decontamination"] = f"""
with words as (
  select doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), item_words as (
  select item_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark
), item_windows as (
  select distinct item_id, least(len(w), 10) as n, w[i : i + least(len(w), 10) - 1] as win
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item_words where len(w) > 0)
), sizes as (select distinct n from item_windows
), doc_windows as (
  select doc_id, i, n, w[i : i + n - 1] as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)
), found as (select doc_id, i, n, item_id from doc_windows join item_windows using (n, win)
), hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join items using (doc_id)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "pages"))


_SQL["op3_line_dedup"] = f"""
with cut as (
  select row_number() over () as id, page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) as site,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '{line_dedup.HIDDEN}', '', 'g'), '{line_dedup.BREAKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g'), chr(10)),
           lambda x: trim(x)), lambda x: x != '') as lines
  from pages
), sites as (select site, count(*) as site_pages from cut group by site
), boilerplate as (
  select site, list(line) as dropped
  from (
    select site, line, count(*) as n
    from (select distinct id, site, unnest(lines) as line from cut where site != '') group by site, line
  ) join sites using (site)
  where site_pages >= 5 and n > 1 and n > site_pages * 0.1 group by site
), kept as (
  select page_id, site, site_pages, lines,
         list_filter(lines, lambda x: not list_contains(coalesce(dropped, []), x)) as kept
  from cut join sites using (site) left join boilerplate using (site)
)
select page_id, site, site_pages, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped,
       array_to_string(kept, chr(10)) as text
from kept
"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("node")


_SQL["op4_ngram_jaccard_join"] = f"""
with recursive words as (
  select doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), cells as (
  select distinct doc_id, w[i : i + least(len(w), 4) - 1] as s
  from (select *, unnest(range(1, len(w) - least(len(w), 4) + 2)) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from cells group by doc_id
), pair_counts as (
  select a.doc_id as a, b.doc_id as b, count(*) as overlap
  from cells a join cells b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pair_counts join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * overlap >= 85 * (x.n + y.n - overlap)
), steps as (select a, b from links union all select b, a from links
), reached as (
  select doc_id as origin, doc_id as node from documents
  union
  select origin, b from reached join steps on node = a
)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(node) as component_id
from documents d left join sizes using (doc_id) left join reached on origin = d.doc_id group by d.doc_id
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    sized = materialize(sized, "sizes")
    mixed = mixing.copies(sized, mixing.plan(sized))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_SQL["op5_source_mixing"] = """
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         1.0::double + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sized group by source
), reshare as (
  select 0 as step, 0.0::double as share, -1::bigint as capped
  union all
  select step + 1, next.share, next.capped
  from reshare, lateral (
    select ((select sum(source_size) from sources) - sum(case when weight * reshare.share > 3 * source_size then 3 * source_size else 0 end))::double
           / sum(case when weight * reshare.share > 3 * source_size then 0.0 else weight end) as share,
           count_if(weight * reshare.share > 3 * source_size)::bigint as capped
    from sources
  ) as next
  where next.capped != reshare.capped
), targets as (
  select source, source_size, least(weight * (select share from reshare order by step desc limit 1), (3 * source_size)::double) as target
  from sources
), expected as (
  select doc_id, s.source, size, source_size, target,
         least(case when source_size > 0 then target / source_size::double else 0.0 end, 3.0::double) as e,
         ('0x' || substr(md5(concat_ws('|', '42', coalesce(doc_id::varchar, ''))), 1, 8))::bigint::double / 4294967296.0::double as u
  from sized s join targets t on s.source is not distinct from t.source
), odds as (
  select *, floor(e) as sure, e - floor(e) as p,
         case when e - floor(e) > 0 then (u / (1.0::double - u)) / ((e - floor(e)) / (1.0::double - (e - floor(e)))) end as q
  from expected
), ranked as (
  select *, q / (1.0::double + q) as r,
         (target - sum(sure * size) over (partition by source)) as need
  from odds
), runs as (
  select *, sum(size) over (partition by source order by r, doc_id) as upto from ranked where r is not null
), drawn as (
  select doc_id, source from runs
  where upto - need <= 0 or (upto - size < need and upto - need <= need - (upto - size))
)
select r.doc_id, size, source_size, target,
       ((sure + case when d.doc_id is not null then 1 else 0 end) * size)::bigint as taken
from ranked r left join drawn d on r.doc_id = d.doc_id
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 24)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language_id.fit(docs, ~F.col("held_out"))
    found = language_id.predict(docs.drop("lang"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "ambiguous")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), ~held_out)
    predicted = (F.col("toxicity") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), predicted)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_lattice_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2, kind="lang")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), misspelt=97)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(named.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
