"""The queries ``opN_<name>``: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.llm import (
    decontamination,
    html_extraction,
    importance_resampling,
    jaccard_join,
    language_id,
    line_dedup,
    order_minhash,
    quality_classifier,
    secret_scan,
    sentencepiece_codec,
    sharding,
    token_counts,
    whitening,
)
from lakeprofile.llm.common import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZERS = "/opt/tokenizers"  # folder of the public vocabulary files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def main_text(spark: SparkSession, folder: str) -> DataFrame:
    done = html_extraction.extract_pages(table(spark, folder, "pages"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


SEPARATOR = 50256  # end of document in the byte-level vocabulary; ordinary text never gets it
# Fixed value: how the byte-level vocabulary cuts words.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def separator_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "token-blocks")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    token_counts.write_token_blocks(docs, path, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", CUT, SEPARATOR)
    return token_counts.counts_by_document(spark, path, SEPARATOR).select("doc_id", "n_tokens")


SHARDS = 40


def hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards_of(table(spark, folder, "documents"), SHARDS)


def piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = sentencepiece_codec.encode_decode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = decontamination.scan_documents(docs, table(spark, folder, "benchmark"))
    scan = F.col("scan")
    return done.select(
        "doc_id",
        scan["n_words"].alias("n_words"),
        decontamination.n_hit(scan).alias("n_hit"),
        F.size(scan["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(scan["items"], ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(scan).alias("contaminated"),
    )


def line_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.delete_repeated_runs(docs)
    return done.select(
        "doc_id",
        "lines_deleted",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, folder, "documents"), jaccard_join.Rule(words=3, percent=90))
    return found.select("doc_id", "n_shingles", "component_id")


def order_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    done = order_minhash.edit_fingerprints(table(spark, folder, "documents"))
    prints = {c: order_minhash.shown(F.col(c)) for c in ("fingerprint", "edited_fingerprint")}
    return done.withColumns(prints)


def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    done = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [secret_scan.count(F.col("spans"), k).alias(f"n_{n}") for k, n in enumerate(secret_scan.KINDS[:3])]
    return done.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def language_identification(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    profiles = language_id.learn(docs.where(~held_out))
    done = language_id.predict(docs.select("doc_id", "text"), profiles)
    return done.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    done = whitening.whiten(table(spark, folder, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").try_cast("bigint"))


GOOD = 0.3  # least score of a document that is taken for good


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, folder, "labels").select("doc_id", "quality").where(~held_out)
    done = quality_classifier.classify(table(spark, folder, "documents"), labels)
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return importance_resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    "op1_html_extraction": main_text,
    "op2_sharding": hash_tree_shards,
    "op3_token_counts": separator_counts,
    "op4_sentencepiece": piece_encoding,
    "op8_decontamination": benchmark_decontamination,
    "op5_line_dedup": line_runs,
    "op6_order_minhash": order_fingerprints,
    "op7_jaccard_join": jaccard_components,
    "op9_secret_scan": secret_spans,
    "op10_language_id": language_identification,
    "op11_whitening": whitened_embeddings,
    "op12_quality_classifier": quality_scores,
    "op13_importance_resampling": target_resampling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _draw(name: str, weight: str) -> str:
    digits = f"('0x' || substr(md5(key || '|' || {name}), 1, {sharding._DIGITS}))::bigint::double"
    return f"-ln(({digits} + 0.5) / {16**sharding._DIGITS}.0) / {weight}"


# The checksum is computed byte by byte from its table, which follows from the polynomial.
_CHECKSUM_TABLE = """bits(i, k, c) as (
  select i, 0, i::bigint from range(256) r(i) union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
tab as (select list(c order by i) as t from bits where k = 8)"""


def _checksum(text: str) -> str:
    """The unsigned checksum of a text, beside the table ``tab``."""
    found = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"
    step = "lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {found}), {step}), 4294967295)"


_REGION = sharding.RACKS_PER_REGION * sharding.SHARDS_PER_RACK

SQL: dict[str, str] = {
    "op2_sharding": f"""
with recursive {_CHECKSUM_TABLE},
d as (select row_number() over () as r, doc_id, coalesce(doc_id::varchar, 'null') as key, encode(coalesce(text, '')) as s
      from documents),
b as (select *, [('0x' || h)::bigint for h in regexp_extract_all(hex(s), '..')] as bytes from d),
c as (
  select r, doc_id, key, octet_length(s) + {sharding.OVERHEAD} as size,
    xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295)
      as text_crc32
  from b, tab),
regions as (
  select r, key, arg_min(f, {_draw("'region of shard ' || f", f"{_REGION}.0")}) as region,
    min({_draw("'region of shard ' || f", f"{_REGION}.0")}) as best
  from c, range(0, {SHARDS}, {_REGION}) u(f) group by r, key),
racks as (
  select r, key, best, arg_min(f, {_draw("'rack of shard ' || f", f"{sharding.SHARDS_PER_RACK}.0")}) as rack
  from regions, unnest(range(region, region + {_REGION}, {sharding.SHARDS_PER_RACK})) u(f) group by r, key, best),
leaves as (
  select r, key, best, arg_min(f, {_draw("'shard ' || f", "1.0")}) as shard
  from racks, unnest(range(rack, rack + {sharding.SHARDS_PER_RACK})) u(f) group by r, key, best),
placed as (
  select c.*, shard::int as shard,
    (case when {_draw(f"'region of shard {SHARDS}'", "1.0").replace("key", "c.key")} < best then {SHARDS} else shard end)::int
      as grown_shard
  from c join leaves using (r))
select doc_id, size::bigint as size, text_crc32, '{sharding.LAW}' as law, shard,
  row_number() over (partition by shard order by doc_id nulls first, size, text_crc32, grown_shard) - 1 as slot, grown_shard
from placed""",
    "op7_jaccard_join": f"""
with recursive w as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sh as (
  select distinct r, array_to_string(w[i : i + 2], ' ') as s
  from w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as u(i) where len(w) > 0),
n as (select r, count(*) as n from sh group by r),
pairs as (select a.r as ra, b.r as rb, count(*) as c from sh a join sh b on a.s = b.s and a.r < b.r group by all),
links as (
  select ra, rb from pairs join n x on x.r = ra join n y on y.r = rb where 100 * c >= 90 * (x.n + y.n - c)),
edges as (select ra, rb from links union all select rb, ra from links),
reach(r, x) as (select r, r from w union select reach.r, edges.rb from reach join edges on reach.x = edges.ra)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(o.doc_id) as component_id
from w left join n using (r) join reach using (r) join w o on o.r = reach.x group by w.r, w.doc_id, n.n""",
    "op8_decontamination": f"""
with dw as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
bw as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
  from bw, unnest(range(1, len(w) - least(13, len(w)) + 2)) as u(i) where len(w) > 0),
sizes as (select distinct n from win),
spots as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as s from dw, sizes, unnest(range(1, len(w) - n + 2)) as u(i)),
hits as (select r, i, win.n, item_id from spots join win on spots.n = win.n and spots.s = win.s),
words as (select r, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as u(p) group by r),
items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct r, cast(item_id as varchar) as item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join words using (r) left join items using (r)""",
    "op13_importance_resampling": f"""
with recursive {_CHECKSUM_TABLE},
dw as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
df as (select r, unnest(w) as word from dw),
bf as (select unnest({_WORDS}) as word from benchmark),
hashed as (
  select word, {_checksum("word")} % {importance_resampling.BUCKETS} as bucket
  from (select word from df union select word from bf), tab),
own as (select bucket, count(*) as n from df join hashed using (word) group by 1),
wanted as (select bucket, count(*) as n from bf join hashed using (word) group by 1),
sums as (
  select coalesce((select sum(n) from own), 0) + {importance_resampling.BUCKETS}.0::double as a,
    coalesce((select sum(n) from wanted), 0) + {importance_resampling.BUCKETS}.0::double as b),
gains as (
  select bucket, floor(1000 * ln(((coalesce(wanted.n, 0) + 1) * a) / ((own.n + 1) * b)))::bigint as gain
  from own left join wanted using (bucket), sums),
weighed as (
  select r, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight
  from df join hashed using (word) join gains using (bucket) group by r),
draws as (
  select r, doc_id, len(w) as n_words, ('0x' || substr(sha256('{importance_resampling.SEED}:' || doc_id), 1, 8))::bigint as h from dw),
scored as (
  select r, doc_id, n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))))::bigint as score
  from draws left join weighed using (r)),
placed as (
  select r, row_number() over (order by score desc, doc_id) as place, count(*) over () as n
  from scored where n_words >= {importance_resampling.LEAST_WORDS})
select doc_id, n_features, weight, score,
  case when place <= floor(n * {importance_resampling.PERCENT} / 100) then place end::bigint as rank
from scored left join placed using (r)""",
}
