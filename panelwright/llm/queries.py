"""The queries of this package over the tables in a folder, by name, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls, rule_table

    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_by_source

    return mix_by_source(table(spark, sf_dir, "documents")).select("doc_id", "epoch", "domain", "lang", "source", "tokens")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunks import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, scored, train

    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "above_quantile")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    found = round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .balltree import top_k, vectors

    found = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(found, found.where("vec_id % 50 = 0"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import damage, report

    return report(damage(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_html, op2_urls, op3_licenses, op4_mixing, op5_simhash, op6_decontaminate, op7_chunks, op8_quality, op9_warc, op10_balltree, op11_spelling, op12_pieces, op13_turns)}

ORACLES: dict[str, str] = {
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        s as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
        w as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as leader from s)
        select page_id, payload_bytes, payload_digest,
               case when leader <> page_id then 'revisit' else 'response' end as record_type,
               case when leader <> page_id then leader end as refers_to
        from w
    """,
    "op10_balltree": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where vec_id is not null and embedding is not null
        ), scored as (
            select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5
    """,
    "op11_spelling": """
        with recursive crc_table as (
            select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as t from range(256) r(b)
        ), runs as (
            select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
            from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as r from documents)
        ), counted as (
            select run, coalesce(doc_id::varchar, '') || ':' || run as named, count(*) as k from runs group by doc_id, run
        ), hashed as (
            select run, k, xor(list_reduce(list_transform(range(1, length(hex(encode(named))) + 1, 2), lambda i: ('0x' || substr(hex(encode(named)), i, 2))::bigint),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h
            from counted, crc_table
        ), vocab as (
            select w as word, sum(k)::bigint as n
            from (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as w, k from hashed)
            where length(w) >= 6 group by w having sum(k) >= 5
        ), cut as (
            select word, n, unnest(range(1, length(word) + 1)) as i from vocab
        ), near as (
            select distinct a.word as word, a.n as n, b.word as near, b.n as near_n
            from cut a join cut b on a.i = b.i and substr(a.word, 1, a.i - 1) || '_' || substr(a.word, a.i + 1) = substr(b.word, 1, b.i - 1) || '_' || substr(b.word, b.i + 1) and a.word <> b.word
            union select c.word, c.n, v.word, v.n from cut c join vocab v on substr(c.word, 1, c.i - 1) || substr(c.word, c.i + 1) = v.word
            union select v.word, v.n, c.word, c.n from cut c join vocab v on substr(c.word, 1, c.i - 1) || substr(c.word, c.i + 1) = v.word
        ), best as (
            select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by word
        ), formed as (
            select v.word, v.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.near_n >= 5 * v.n then b.near end as form, case when b.near_n >= 5 * v.n then b.near_n end as form_n
            from vocab v left join best b on b.word = v.word
        ), walked as (
            select word, word as at from formed
            union all select w.word, f.form from walked w join formed f on f.word = w.at where f.form is not null
        )
        select f.word, f.form, w.at as root, f.n, f.n_near, f.form_n
        from formed f join walked w on w.word = f.word join formed e on e.word = w.at and e.form is null
    """,
}
