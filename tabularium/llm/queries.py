"""Registered queries of the training-data operators and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, lines, media, minhash, mixing, runs, sharding, suffix, tokens, trie, warc
from .shared import new_folder, staged


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(doc_id) as keeper from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
j as (select k.*, (r.key is not null and k.doc_id <> r.keeper) as gone from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), sharding.map_folder(spark, 8), n_shards=8)


def op1_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_documents(spark, sf_dir))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), mixing.TARGETS)


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the kept trees: a table that edits start from; the second round starts from the trees that the first one returns
    trees = staged(tokens.build(_documents(spark, sf_dir).select("doc_id", "text")), "trees", compression="zstd")
    edits = tokens.redactions(F.col("text")).alias("edits")
    first = tokens.edited(trees.select("*", edits))
    counts = ["n_tokens", "n_pieces", "n_edits", "n_tokens_after", "n_reencoded"]
    held = {f"{c}_1": F.col(c) for c in counts}
    again = first.select("doc_id", "text", "sums", "blocks", edits, *(c.alias(n) for n, c in held.items()))
    second = tokens.edited(again, carry=tuple(held))
    return second.select(
        "doc_id", *(F.col(f"{c}_1").alias(c) for c in counts), F.col("n_edits").alias("n_edits_2"), F.col("n_tokens_after").alias("n_tokens_2"),
        F.col("n_reencoded").alias("n_reencoded_2"), "n_blocks", "n_blocks_read")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_texts(media.store_texts(_documents(spark, sf_dir)))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = warc.read_archives(spark, folder, payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h from p),
k as (select *, max(page_id) over (partition by h) as keeper from d)
select page_id, n as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
    case when page_id = keeper then 'response' else 'revisit' end as record_type,
    case when page_id <> keeper then keeper end as refers_to
from k
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_spans")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.prefix_trie(*trie.rebuilt(turns))


OP11_SQL = """
with t as (select conv_id, struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) as turn_of,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place
    from conversations where conv_id is not null),
s as (select conv_id, count(*) as n, list(turn_of order by place) as own, CAST(conv_id AS VARCHAR) as name from t group by conv_id),
b as (select *, list_transform(range(8 * length(name)), lambda i: CAST((ascii(substr(name, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT)) as bits from s),
h as (select *, xor(list_reduce(list_prepend(4294967295, bits), lambda c, x: xor(c >> 1, 3988292384 * xor(c & 1, x))), 4294967295) % 9 as h from b),
r as (select a.conv_id, list_concat(coalesce(list_slice(c.own, 1, a.h), []), list_slice(a.own, a.h + 1, a.n)) as turns
    from h a left join s c on c.conv_id = a.conv_id - a.conv_id % 5),
p as (select conv_id, len(turns) as n_turns, unnest(range(0, len(turns) + 1)) as depth, turns from r),
k as (select conv_id, n_turns, depth, list_slice(turns, 1, depth) as key, case when depth > 0 then strlen(turns[depth].body) else 0 end as bytes from p),
n as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' order by conv_id) filter (n_turns = depth), '')) as ends_sha256 from k group by key, depth),
m as (select k.conv_id as member, k.depth, n.conv_id as node from k join n on k.key = n.key and k.depth = n.depth),
q as (select n.*, m.node as parent_conv_id from n left join m on m.member = n.conv_id and m.depth = n.depth - 1),
c as (select parent_conv_id as node, depth - 1 as depth, count(*) as n_children from q where depth > 0 group by 1, 2),
f as (select q.*, coalesce(c.n_children, 0) as n_children from q left join c on c.node = q.conv_id and c.depth = q.depth),
u as (select m.node as conv_id, m.depth, count(*) filter (f.n_children = 0) as n_leaves, sum((f.n_convs - 1) * f.bytes) as saved_tokens
    from f join m on m.member = f.conv_id and m.depth <= f.depth group by 1, 2)
select f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) as saved_tokens, f.ends_sha256
from f join u on f.conv_id = u.conv_id and f.depth = u.depth
"""


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    done = bpe.round_trip(docs, bpe.lexicon(docs))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", ",")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = runs.periodic_runs(docs.select("doc_id", runs.replayed(F.col("text"), F.col("doc_id")).alias("text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        digest(runs.runs_text(F.col("runs"))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dartminhash": op1_dartminhash,
    "op2_soft_mixing": op2_soft_mixing,
    "op3_edit_token_counts": op3_edit_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_warc_zstd": op6_warc_zstd,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_gif_media": op10_gif_media,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bpe_transducer": op12_bpe_transducer,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op6_warc_zstd": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_prefix_trie": OP11_SQL}
