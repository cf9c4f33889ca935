"""The queries of the training-data operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.bestfit_pack import pack
from flowloom.llm.common import Scratch, table
from flowloom.llm.decontaminate import contaminated
from flowloom.llm.html_extract import extract
from flowloom.llm.minhash_dedup import near_duplicates
from flowloom.llm.paragraph_dedup import repeated_passages
from flowloom.llm.shard_tree import assign_shards
from flowloom.llm.suffix_dedup import repeats
from flowloom.llm.topk_search import top_k
from flowloom.llm.toxicity import fit, score
from flowloom.llm.warc import archived_pages, read_warc, write_warc


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op6_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path()
    write_warc(table(spark, sf_dir, "pages"), path, scratch=scratch)
    return archived_pages(read_warc(spark, path, scratch), scratch)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_shard_tree": op2_shard_tree,
    "op3_topk_search": op3_topk_search,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bestfit_pack": op6_bestfit_pack,
    "op7_paragraph_dedup": op7_paragraph_dedup,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_extract": op10_html_extract,
}

OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
each as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s
  from words),
sizes as (select doc_id, len(s) n, hash(list_sort(s)) h from each),
firsts as (select h, n, min(doc_id) rep from sizes where n > 0 group by all),
shingles as (select f.rep, f.n, unnest(e.s) g from firsts f join each e on e.doc_id = f.rep),
links as (
  select a.rep a, b.rep b from shingles a join shingles b on a.g = b.g and a.rep <> b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
walk as (select rep node, rep c from firsts union select l.b, w.c from walk w join links l on l.a = w.node),
least_of as (select node, min(c) c from walk group by node)
select s.doc_id, s.n n_shingles, coalesce(l.c, s.doc_id) component_id, s.doc_id = coalesce(l.c, s.doc_id) kept
from sizes s left join firsts f on s.h = f.h and s.n = f.n left join least_of l on l.node = f.rep
"""

CRC_SQL = """step as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(n as bigint)) order by n) t
  from range(256) r(n)),
crc as (
  select text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h as bigint)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) crc
  from (select distinct coalesce(text, '') text from documents), step)"""

OP2_SQL = f"""
with {CRC_SQL},
leaf as (
  select rowid_, doc_id, text, s, (cast('0x' || md5(coalesce(cast(doc_id as varchar), 'null') || ':' || s)[1:12] as bigint) + 0.5) / 281474976710656.0 u
  from (select row_number() over () rowid_, * from documents), range(41) t(s)),
best as (
  select rowid_, any_value(doc_id) doc_id, any_value(text) text,
    arg_min(s, -ln(u)) filter (s < 40) shard, arg_min(s, -ln(u)) grown_shard
  from leaf group by rowid_),
sized as (
  select doc_id, cast(strlen(coalesce(text, '')) + 16 as bigint) size, coalesce(text, '') text, cast(shard as int) shard, cast(grown_shard as int) grown_shard from best)
select doc_id, size, crc.crc text_crc32, 'key' law, shard,
  row_number() over (partition by shard order by doc_id nulls first, size) - 1 slot, grown_shard, shard // 20 region, shard // 4 rack
from sized join crc using (text)
"""

OP3_SQL = """
with cells as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score
  from cells q, cells c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score
from scored qualify rank <= 5
"""

OP8_SQL = """
with hashed as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) x from pages),
heads as (select x, max(page_id) head from hashed group by x)
select page_id, n payload_bytes,
  array_to_string(list_transform(list_transform(range(8), lambda i: cast('0x' || x[5 * i + 1:5 * i + 5] as bigint)), lambda v:
    array_to_string(list_transform([15, 10, 5, 0], lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> k) & 31) + 1]), '')), '') payload_digest,
  case when page_id = head then 'response' else 'revisit' end record_type, case when page_id <> head then head end refers_to
from hashed join heads using (x)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_shard_tree": OP2_SQL,
    "op3_topk_search": OP3_SQL,
    "op8_warc": OP8_SQL,
}
