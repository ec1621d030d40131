"""Queries that go through files and back: corpora, transcripts, signatures, index folders, models, responses.

What is written goes to the session's shared folder and is deleted when the application ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import cold, embed, markov, search
from parley.plans.registry import B_ALL, B_FEATURES, B_HASHES, TOKENS, TRANS, V, first_query, hashes, packed, register, table, turns, vectors
from parley.session import scratch
from parley.sources import index_io as io


@register("SELECT doc_id::VARCHAR AS id, source AS event, length(text)::INTEGER AS chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def file_corpus(spark, d):
    """Documents as JSON lines and back."""
    path = scratch(spark, "corpus")
    rows = table(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("event"))
    rows.select(F.to_json(F.struct("id", "text", "event"))).write.text(path)
    return io.read_corpus(spark, path).select("id", "event", F.length("text").alias("chars"))


@register("SELECT events, count(*) AS n FROM (SELECT list(event_type ORDER BY ts, event_id) AS events FROM events GROUP BY user_id HAVING count(*) >= 2) GROUP BY events")
def file_transcripts(spark, d):
    """Sessions as transcript lines of both shapes, every other one as turns, and back."""
    path = scratch(spark, "transcripts")
    t = table(spark, d, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    whole = markov.sequences(t.where("session % 2 = 0")).select(F.to_json(F.struct("events")).alias("value"))
    turn = t.where("session % 2 <> 0").repartition("session").sortWithinPartitions("session", "ts", "seq").select(F.to_json(F.struct(F.col("session").cast("string").alias("session"), "event")).alias("value"))
    whole.write.text(f"{path}/whole")
    turn.write.text(f"{path}/turns")
    back = io.read_transcripts(spark, f"{path}/*")
    return markov.sequences(back).groupBy("events").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH w AS (SELECT vec_id, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, x: a * 2 + x) AS n FROM embeddings)
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS doc_idx, (CASE WHEN n >= 9223372036854775808::HUGEINT THEN n - 18446744073709551616::HUGEINT ELSE n END)::BIGINT AS s0 FROM w""")
def file_signatures(spark, d):
    """Signatures as a packed file and back; rows are numbered by their place in it."""
    path = scratch(spark, "signatures")
    io.write_signatures(vectors(spark, d).select("doc_idx", "s0"), path, 64)
    return io.read_signatures(spark, path, 64)


@register(f"""WITH {B_FEATURES}, {B_HASHES}, {B_ALL}, x AS {packed('bac', 'item_id', False)}, p AS (SELECT item_id, row_number() OVER (ORDER BY item_id::VARCHAR, text) - 1 AS doc_idx FROM benchmark),
q AS (SELECT * FROM x ORDER BY item_id LIMIT 1), h AS (SELECT doc_idx, x.item_id, {' + '.join(f'bit_count(xor(x.s{w}, q.s{w}))::INTEGER' for w in range(4))} AS distance FROM x JOIN p ON p.item_id = x.item_id, q)
SELECT row_number() OVER (ORDER BY distance, doc_idx)::INTEGER AS rank, distance::INTEGER AS distance, doc_idx, item_id::VARCHAR AS id, '_default' AS event FROM h ORDER BY distance, doc_idx LIMIT 5""")
def file_index(spark, d):
    """An index folder of the benchmark, asked for the text of its first item."""
    path, b = scratch(spark, "index"), table(spark, d, "benchmark")
    io.build_index(b.select(F.col("item_id").cast("string").alias("id"), "text", F.lit(None).cast("string").alias("event")), path)
    return io.query_index(spark, path, b.orderBy("item_id").first()["text"], 5).select("rank", "distance", "doc_idx", "id", "event")


@register(f"WITH {TRANS} SELECT ord, context, next, round(weight * 0.25, 6) AS weight FROM m WHERE ord <= 2")
def file_markov(spark, d):
    """Transitions of three orders, saved two half-lives later, loaded up to the second order."""
    path = scratch(spark, "markov")
    io.save_markov(markov.transitions(turns(spark, d)), path, half_life_s=60.0, elapsed_s=120.0)
    return io.load_markov(spark, path, 2).withColumn("weight", F.round("weight", 6))


@register("""WITH w AS (SELECT vec_id, label, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, x: a * 2 + x) AS n FROM embeddings)
SELECT row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS insert_seq, (CASE WHEN n >= 9223372036854775808::HUGEINT THEN n - 18446744073709551616::HUGEINT ELSE n END)::BIGINT AS s0, label::BIGINT * 4294967296 + vec_id AS value FROM w""")
def file_cold(spark, d):
    """A cold store filled in two parts, of which the first is compacted."""
    tier = cold.ColdTier(spark, scratch(spark, "cold"), 64)
    v = vectors(spark, d).withColumn("event_id", F.col("event").cast("int"))
    for odd, compact in ((0, 1), (1, 10**9)):
        part = io.numbered(v.where(F.col("doc_idx") % 2 == odd), ["doc_idx"], "ordinal", scratch(spark, "numbered"))
        tier.append(part.select("s0", "event_id", "doc_idx", "ordinal"), compact)
    return tier.rows()


@register("SELECT i::INTEGER AS bit, j::INTEGER AS dim, round((CASE WHEN substr(md5('7|' || i || '|' || j), 9, 1) >= '8' THEN 1 ELSE -1 END) / 8.0, 6) AS weight FROM range(0, 256) a(i), range(0, 64) b(j)")
def file_matrix(spark, d):
    """The projection of the embeddings, saved and loaded."""
    path = scratch(spark, "matrix")
    io.save_matrix(spark, embed.random_projection(64, 256), path)
    m = io.load_matrix(spark, path)
    return spark.createDataFrame([(i, j, round(float(x), 6)) for i, r in enumerate(m) for j, x in enumerate(r)], "bit int, dim int, weight double")


HITS = f"WITH {V}, h AS (SELECT row_number() OVER (ORDER BY distance, doc_idx)::INTEGER AS rank, distance, doc_idx::VARCHAR AS id, label::VARCHAR AS event FROM d ORDER BY distance, doc_idx LIMIT 5)"


def _hits(spark, d):
    v = vectors(spark, d)
    ids = v.select("doc_idx", F.col("doc_idx").cast("string").alias("id"), F.lit(None).cast("string").alias("text"))
    return search.render(search.top_k(v, first_query(spark, d), 5), ids, v.select("doc_idx", "event"))


@register(f"{HITS} SELECT rank, distance, id, event, id AS text FROM h")
def json_response(spark, d):
    """The response to a query as JSON, read again."""
    kind = "results array<struct<rank:int,distance:int,id:string,event:string,text:string>>"
    return io.to_response(_hits(spark, d)).select(F.inline(F.from_json("response", kind)["results"]))


@register(f"{HITS} SELECT string_agg('[' || rank || '] (' || event || ') ' || id, chr(10) ORDER BY rank) AS content, 'assistant' AS role, 4 AS prompt_tokens, 15 AS completion_tokens, 19 AS total_tokens FROM h")
def chat_completion(spark, d):
    """A completion over the hits, its usage counted in words."""
    r = io.completion(_hits(spark, d), "what is near this")
    at = lambda path, name, kind="string": F.get_json_object("response", path).cast(kind).alias(name)
    return r.select(at("$.choices[0].message.content", "content"), at("$.choices[0].message.role", "role"), *[at(f"$.usage.{x}", x, "int") for x in ("prompt_tokens", "completion_tokens", "total_tokens")])


@register("SELECT page_id::VARCHAR AS id, url AS event, length(html)::INTEGER AS chars FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL")
def import_table(spark, d):
    """A corpus from a table with other column names."""
    return io.import_corpus(spark, f"{d}/pages.parquet", "parquet", "page_id", "html", "url").select("id", "event", F.length("text").alias("chars"))


@register(f"""WITH {TOKENS}, ft AS (SELECT doc_id, unnest(w) AS token FROM tk), {hashes(128)} SELECT doc_id, pos, value FROM cp""")
def feature_hash_plain(spark, d):
    """Unigrams alone, stop words kept, in 128 dimensions."""
    return embed.hashed_components(table(spark, d, "documents"), "doc_id", dim=128, use_bigrams=False, drop_stop_words=False)
