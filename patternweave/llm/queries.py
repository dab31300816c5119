"""The registered queries of the corpus operators, with production parameters.

Each runs its operator over its whole table and derives the digest columns of
its contract from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, embedding_dedup, langid, license_scan, line_dedup, pii, quality, runtime, simhash, token_output


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write packed shards of ``documents`` and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = runtime.new_path(spark, "tokens")
    token_output.write_token_files(runtime.load(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    digests = token_output.read_token_files(spark, path).select("shard", "doc_id", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return token_output.with_starts(runtime.materialize(digests, "token-digests")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score ``documents`` by a classifier fitted on labels of rows that aren't held out."""
    docs, labels = runtime.load(spark, sf_dir, "documents"), runtime.load(spark, sf_dir, "labels")
    vectors, net = quality.fit(docs, labels.where(runtime.held("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), vectors, net)
    return scored.select("doc_id", (runtime.held("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in ``documents``: words, hit words, items."""
    found = decontamination.decontaminate(runtime.load(spark, sf_dir, "documents"), runtime.load(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among ``embeddings``, and their components."""
    return embedding_dedup.near_duplicates(runtime.load(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of ``documents``."""
    found = simhash.near_duplicates(runtime.load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of ``documents``, as digests."""
    made = bpe.encode_decode(runtime.load(spark, sf_dir, "documents"), tokenizer_path())
    return made.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered template spans of ``documents``."""
    found = license_scan.scan_licenses(runtime.load(spark, sf_dir, "documents"))
    places, base = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda x: x["label"]))))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learned from rows that aren't held out."""
    docs = runtime.load(spark, sf_dir, "documents")
    prototypes = langid.learn(docs.where(runtime.held("doc_id", 3) != 1))
    return langid.predict(docs, prototypes).select("doc_id", (runtime.held("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without later repeated runs of lines: doc_id, text, n_lines, n_deleted, emptied."""
    return line_dedup.dedup_lines(runtime.load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in ``documents``."""
    found = pii.find_pii(runtime.load(spark, sf_dir, "documents"))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_output, op2_quality, op3_decontamination, op4_embedding_dedup, op5_simhash, op6_bpe, op7_license_scan, op8_language_id, op9_line_dedup, op10_pii)}

#: Words of op3 and op7, as DuckDB takes them; A-Z are lower-cased alone.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
with d as (select row_number() over () as r, doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
b as (select cast(item_id as varchar) as item_id, {_WORDS.format("text")} as w from benchmark where item_id is not null and text is not null),
g as (select distinct item_id, least(len(w), 10) as n, unnest([array_to_string(w[i : i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) as g from b where len(w) > 0),
sizes as (select distinct n from g),
dw as (select r, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
dg as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as g from dw),
hit as (select dg.r, dg.n, dg.i, g.item_id from dg join g on dg.n = g.n and dg.g = g.g),
hw as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hit) group by r),
it as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (r) left join it using (r)
""",
    "op4_embedding_dedup": """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from v where len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0),
link as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and a.size > 0 and b.size > 0 and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach as (select vec_id as a, vec_id as b from v union select reach.a, link.b from reach join link on reach.b = link.a),
c as (select a, min(b) as component_id from reach group by a),
k as (select a, count(*) as n_links from link group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from v join c on c.a = vec_id left join k on k.a = vec_id
""",
    "op9_line_dedup": """
with t as (select doc_id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
w as (select *, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) as n from t),
l as (select doc_id, pos, n, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as line, row_number() over (partition by doc_id order by pos) as k, sum(n) over (partition by doc_id order by pos) as upto from w where n > 0),
d as (select doc_id, list(line order by k) as ls from l group by doc_id),
u as (select a.doc_id, a.k as a, b.k as b from l a join l b on a.doc_id = b.doc_id and a.k <= b.k and b.upto - a.upto + a.n >= 50 and (b.upto - b.n - a.upto + a.n < 50 or b.upto - a.upto < 50)),
s as (select doc_id, a, b, array_to_string(ls[a : b], chr(10)) as body from u join d using (doc_id)),
f as (select body, min({'d': doc_id, 'a': a, 'b': b}) as o from s group by body),
g as (select distinct doc_id, unnest(range(a, b + 1)) as k from s join f using (body) where doc_id <> o.d or a > o.b),
gone as (select l.doc_id, l.pos, l.k, lead(l.k) over (partition by l.doc_id order by l.k) = l.k + 1 as joined, lead(l.pos) over (partition by l.doc_id order by l.k) as next_pos from l join g on g.doc_id = l.doc_id and g.k = l.k),
x as (select t.doc_id, t.pos, t.raw, exists (select 1 from gone where gone.doc_id = t.doc_id and (gone.pos = t.pos or (gone.joined and t.pos > gone.pos and t.pos < gone.next_pos))) as cut from t),
r as (select doc_id, string_agg(raw, chr(10) order by pos) filter (where not cut) as text, count(*) as n_lines, cast(count_if(cut) as bigint) as n_deleted from x group by doc_id)
select doc_id, case when documents.text is null then null else coalesce(r.text, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted, coalesce(n_deleted, 0) > 0 and not regexp_matches(coalesce(r.text, ''), '[^\\x20\\x09-\\x0D]') as emptied
from documents left join r using (doc_id)
""",
}
