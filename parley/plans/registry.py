"""Queries over the engine's operators, each with the SQL it must agree with where SQL can state it.

Corpora: `embeddings` as 64-bit signatures with the label as event, `documents`
as 256-bit text signatures with the source as event, `events` as sessions of
users, `conversations` as streams of utterances.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import signature as S
from parley.functions import text as T
from parley.operators import catalog, cold, embed, markov, metrics, search, successor
from parley.session import stored
from parley.streaming import requests
from parley.streaming import session as live

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- corpora -----------------------------------------------------------------------------------------------------


def vectors(spark, d) -> DataFrame:
    """(doc_idx, s0, event): embeddings as signatures of one word."""
    e = table(spark, d, "embeddings")
    return S.with_signature(e, "embedding", 64).select(F.col("vec_id").alias("doc_idx"), "s0", F.col("label").cast("string").alias("event"))


def vector_bridge(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_idx"), F.col("label").cast("string").alias("event"))
    return catalog.doc_event(v, catalog.event_dim(v))


def first_query(spark, d) -> list[int]:
    """The signature of the least vec_id."""
    return S.literal_words(vectors(spark, d).orderBy("doc_idx").first(), 64)


def asked(spark, d) -> DataFrame:
    """(query_id, q0, event): the queries of the searches, every vector whose id is divisible by 100."""
    return vectors(spark, d).where("doc_idx % 100 = 0").select(F.col("doc_idx").alias("query_id"), F.col("s0").alias("q0"), F.col("event").alias("own"))


def turns(spark, d) -> DataFrame:
    """(session, ts, seq, event, event_id) of users' events."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    dim = catalog.event_dim(e).select(F.col("event_id"), F.col("name").alias("event"))
    return e.join(F.broadcast(dim), "event") if dim.count() <= 100_000 else e.join(dim, "event")


def text_corpus(spark, d) -> DataFrame:
    return embed.text_signature(table(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "doc_idx")


def utterances(spark, d) -> DataFrame:
    """(session, seq, ts, action, k, s0 .. s3): each user turn as partials of its words, then the whole, then a warm."""
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.split("text", r"\s+").alias("w"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("action"), F.lit(p).alias("part")) for i, (a, p) in enumerate([("observe", 0.25), ("observe", 0.5), ("observe", 0.75), ("finalize", 1.0), ("warm", 1.0)])]))
    rows = c.select("conv_id", "turn", "w", step.alias("x")).select(
        F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 8 + F.col("x.i")).alias("seq"), F.timestamp_seconds(F.col("turn") * 5 + F.col("x.i")).alias("ts"), F.col("x.action").alias("action"),
        F.array_join(F.slice("w", 1, F.greatest(F.ceil(F.size("w") * F.col("x.part")).cast("int"), F.lit(1))), " ").alias("text"),
    )
    rows = embed.spread(rows).withColumn("signature", embed.signature_of("text"))
    return rows.select("session", "seq", "ts", "action", F.lit(10).alias("k"), *[F.col(f"signature.{w}").alias(w) for w in S.word_names(256)])


# --- signatures and search -----------------------------------------------------------------------------------------

V = """v AS (SELECT vec_id AS doc_idx, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')::BIT AS s FROM embeddings),
q AS (SELECT s AS qs FROM v ORDER BY doc_idx LIMIT 1),
d AS (SELECT doc_idx, label, bit_count(xor(s, qs))::INTEGER AS distance FROM v, q)"""
VQ = V.replace("q AS (SELECT s AS qs FROM v ORDER BY doc_idx LIMIT 1)", "q AS (SELECT doc_idx AS query_id, s AS qs, label AS own FROM v WHERE doc_idx % 100 = 0)").replace("d AS (SELECT doc_idx", "d AS (SELECT query_id, own, doc_idx")
DIM = "e AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS event_id FROM (SELECT DISTINCT label::VARCHAR AS name FROM embeddings)), b AS (SELECT doc_idx, event_id FROM v JOIN e ON e.name = v.label::VARCHAR)"


@register("""
WITH w AS (SELECT vec_id AS doc_idx, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, x: a * 2 + x) AS n FROM embeddings)
SELECT doc_idx, (CASE WHEN n >= 9223372036854775808::HUGEINT THEN n - 18446744073709551616::HUGEINT ELSE n END)::BIGINT AS s0 FROM w""")
def sig_pack_64(spark, d):
    return vectors(spark, d).select("doc_idx", "s0")


@register("""
SELECT i::INTEGER AS bit, sum(CASE WHEN embedding[i + 1] >= 0 THEN 1 ELSE 0 END)::BIGINT AS ones FROM embeddings, range(0, 64) t(i) GROUP BY i""")
def sig_bit_freq(spark, d):
    return vectors(spark, d).select(F.posexplode(S.bits_of(["s0"])).alias("bit", "on")).groupBy("bit").agg(F.sum("on").alias("ones"))


@register("SELECT vec_id AS doc_idx, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS bits FROM embeddings")
def sig_to_bits(spark, d):
    return vectors(spark, d).select("doc_idx", S.bits_of(["s0"]).alias("bits"))


@register(f"WITH {VQ} SELECT query_id, doc_idx, distance FROM d WHERE label = own")
def hamming_pairs(spark, d):
    """Distances of every query to all vectors of its event."""
    v = vectors(spark, d)
    q = asked(spark, d)
    return v.join(q, v["event"] == q["own"]).select("query_id", "doc_idx", S.hamming(["s0"], ["q0"]).alias("distance"))


def ranked(d: str, k: int, by: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY distance, doc_idx)::INTEGER AS rank FROM ({d})) WHERE rank <= {k}"


@register(f"WITH {VQ} {ranked('SELECT query_id, doc_idx, distance FROM d', 10)}")
def scan_topk(spark, d):
    return search.knn_join(asked(spark, d), vectors(spark, d), 10, 64)


@register(f"WITH {V} SELECT doc_idx, distance FROM d")
def scan_topk_k_gt_n(spark, d):
    return search.top_k(vectors(spark, d), first_query(spark, d), 1_000_000_000)


@register(f"WITH {VQ} {ranked('SELECT query_id, doc_idx, distance FROM d WHERE label IN (own, (own + 1) % 10)', 10)}")
def subset_topk(spark, d):
    """Of every query the nearest among the rows of its own event and of the next."""
    q, dim = asked(spark, d), catalog.event_dim(vectors(spark, d))
    scopes = q.select("query_id", F.explode(F.array("own", ((F.col("own").cast("int") + 1) % 10).cast("string"))).alias("name")).join(dim, "name")
    return search.scoped_join(q, scopes, vectors(spark, d), vector_bridge(spark, d), 10, 64)


@register(f"WITH {V} SELECT doc_idx, distance FROM d WHERE doc_idx IN (1, 2, 5) ORDER BY distance, doc_idx LIMIT 10")
def subset_out_of_range(spark, d):
    return search.subset_top_k(vectors(spark, d), spark.createDataFrame([(1,), (2,), (2,), (5,), (10**15,)], "doc_idx bigint"), first_query(spark, d), 10)


HIER = f"""WITH {VQ}, {DIM}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_idx) AS r FROM d),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h) AS n FROM (SELECT query_id, event_id, min(distance * 1000000000000 + doc_idx) AS h FROM c JOIN b USING (doc_idx) WHERE r <= 40 GROUP BY query_id, event_id)) WHERE n <= 8),
sc AS (SELECT query_id, doc_idx FROM b JOIN f USING (event_id)), sz AS (SELECT query_id, count(*) AS scope_size FROM sc GROUP BY query_id)"""


@register(f"{HIER} {ranked('SELECT query_id, doc_idx, distance, true AS used_shards, scope_size FROM d JOIN sc USING (query_id, doc_idx) JOIN sz USING (query_id)', 10)}")
def hier_search(spark, d):
    return search.hierarchical_join(asked(spark, d), vectors(spark, d), vector_bridge(spark, d), 10, 64)


@register(f"{HIER} SELECT query_id, event_id::INTEGER AS event_id, (h // 1000000000000)::INTEGER AS distance, (h % 1000000000000)::BIGINT AS doc_idx FROM f")
def hier_candidates(spark, d):
    coarse = search.knn_join(asked(spark, d), vectors(spark, d), 64, 64)
    return search.candidates_of(coarse, vector_bridge(spark, d), 10)


@register(f"{HIER}, h AS ({ranked('SELECT query_id, doc_idx, distance FROM d JOIN sc USING (query_id, doc_idx)', 10)}) SELECT count(*) AS hits, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall FROM h JOIN c USING (query_id, doc_idx)")
def hier_recall(spark, d):
    """The share of hierarchical hits that are among the exact ten nearest, over all queries."""
    q, v = asked(spark, d), vectors(spark, d)
    exact = search.knn_join(q, v, 10, 64).select("query_id", "doc_idx", F.lit(1.0).alias("on"))
    hits = search.hierarchical_join(q, v, vector_bridge(spark, d), 10, 64)
    return hits.join(exact, ["query_id", "doc_idx"], "left").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg(F.coalesce("on", F.lit(0.0))), 6).alias("recall"))


@register(f"WITH {V} SELECT doc_idx, distance, false AS used_shards, (SELECT count(*) FROM v) AS scope_size FROM d ORDER BY distance, doc_idx LIMIT 10")
def hier_single_event(spark, d):
    v = vectors(spark, d)
    return search.hierarchical(v, v.select("doc_idx", F.lit(0).alias("event_id")), first_query(spark, d), 10)


@register(f"WITH {VQ} {ranked('SELECT query_id, doc_idx, distance FROM d', 5)}")
def knn_join(spark, d):
    """As blocks of queries, each broadcast by itself."""
    return search.knn_join(asked(spark, d), vectors(spark, d).select("doc_idx", "s0"), 5, 64, broadcast_rows=64)


@register(f"WITH {VQ} SELECT query_id, doc_idx, distance FROM d WHERE distance <= 24")
def radius_search(spark, d):
    return search.radius_of(asked(spark, d), vectors(spark, d), 24, 64)


@register(f"WITH {VQ}, {DIM} {ranked('SELECT query_id, event_id::INTEGER AS event_id, doc_idx, distance FROM d JOIN b USING (doc_idx)', 4, 'query_id, event_id')}")
def per_event_topk(spark, d):
    return search.per_event_join(asked(spark, d), vectors(spark, d), vector_bridge(spark, d), 4, 64)


@register(f"WITH {V}, {DIM} SELECT doc_idx, distance FROM d JOIN b USING (doc_idx) WHERE event_id IN (0, 2, 4) ORDER BY distance, doc_idx LIMIT 6")
def per_event_merge(spark, d):
    v, b, q = vectors(spark, d), vector_bridge(spark, d), first_query(spark, d)
    return search.merge_top_k([search.per_event_search(v, b, [e], q, 6).select("doc_idx", "distance") for e in (0, 2, 4)], 6)


@register(f"""WITH {V}, h AS (SELECT doc_idx, distance, label, row_number() OVER (ORDER BY distance, doc_idx) AS rank FROM d)
SELECT rank::INTEGER AS rank, distance, doc_idx, coalesce(doc_idx::VARCHAR, '?') AS id, coalesce(text, doc_idx::VARCHAR) AS text, label::VARCHAR AS event FROM h LEFT JOIN documents ON doc_id = doc_idx WHERE rank <= 5""")
def render_hits(spark, d):
    hits = search.top_k(vectors(spark, d), first_query(spark, d), 5)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_idx"), F.col("vec_id").cast("string").alias("id"))
    docs = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), "text"), "doc_idx", "left")
    return search.render(hits, docs, vectors(spark, d).select("doc_idx", "event"))


# --- texts -----------------------------------------------------------------------------------------------------------

STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
TOKENS = "tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)"
FEATURES = f"""{TOKENS}, ts AS (SELECT doc_id, list_filter(w, lambda x: x NOT IN {STOP}) AS w FROM tk),
ft AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) ELSE [] END)) AS token FROM ts)"""


def hashes(dim: int) -> str:
    return f"""hm AS (SELECT doc_id, md5('7|0|' || token) AS h FROM ft),
hs AS (SELECT doc_id, ('0x' || substr(h, 8 * band + 1, 7))::BIGINT % {dim} AS pos, CASE WHEN substr(h, 8 * band + 8, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM hm, range(0, 4) t(band)),
cp AS (SELECT doc_id, pos::INTEGER AS pos, sum(sign)::BIGINT AS value FROM hs GROUP BY doc_id, pos)"""


@register(f"WITH {TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM tk) GROUP BY token")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {TOKENS} SELECT doc_id, len(w)::INTEGER AS tokens, len(list_filter(w, lambda x: x NOT IN {STOP}))::INTEGER AS kept FROM tk")
def stopword_filter(spark, d):
    w = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("tokens"), F.size(T.without_stop_words(w)).alias("kept"))


@register(f"WITH {FEATURES} SELECT token AS bigram, count(*) AS n FROM ft WHERE contains(token, '_') GROUP BY token")
def bigram_counts(spark, d):
    return embed.bigram_counts(table(spark, d, "documents"))


@register(f"WITH {FEATURES}, {hashes(256)} SELECT doc_id, pos, value FROM cp")
def feature_hash(spark, d):
    return embed.hashed_components(table(spark, d, "documents"), "doc_id")


@register(f"WITH {FEATURES}, {hashes(384)} SELECT doc_id, pos, round(CASE WHEN norm > 1e-9 THEN value / norm ELSE value END, 6) AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS norm FROM cp)")
def hashed_embedding_norm(spark, d):
    e = embed.hashed_embedding(table(spark, d, "documents"), "doc_id", dim=384)
    return e.select("doc_id", "pos", F.round("value", 6).alias("value"))


def packed(source: str, key: str, ones: bool) -> str:
    """SQL for the words of a signature from (key, pos, value): all bits but the negative ones, or the positive ones only."""
    test = "value > 0" if ones else "value < 0"
    total = lambda w: f"coalesce(sum(CASE WHEN {test} AND pos // 64 = {w} THEN (2::HUGEINT ** (63 - pos % 64))::HUGEINT ELSE 0 END), 0)::HUGEINT"
    whole = lambda w: total(w) if ones else f"(18446744073709551615::HUGEINT - {total(w)})"
    signed = lambda w: f"(CASE WHEN n{w} >= 9223372036854775808::HUGEINT THEN n{w} - 18446744073709551616::HUGEINT ELSE n{w} END)::BIGINT AS s{w}"
    return f"(SELECT {key}, {', '.join(signed(w) for w in range(4))} FROM (SELECT {key}, {', '.join(f'{whole(w)} AS n{w}' for w in range(4))} FROM {source} GROUP BY {key}))"


ALL_CP = "ac AS (SELECT doc_id, pos, value FROM cp UNION ALL SELECT doc_id, 0, 0 FROM documents)"


@register(f"WITH {FEATURES}, {hashes(256)}, {ALL_CP} SELECT doc_id AS doc_idx, s0, s1, s2, s3 FROM {packed('ac', 'doc_id', False)}")
def text_signature(spark, d):
    return text_corpus(spark, d)


@register(f"""WITH {FEATURES}, {hashes(256)}, {ALL_CP}, y AS {packed('ac', 'doc_id', False)}, c AS (SELECT *, min(doc_id) OVER (PARTITION BY s0, s1, s2, s3) AS rep FROM y), x AS (SELECT * FROM c WHERE rep = doc_id)
SELECT a.doc_id AS a, b.doc_id AS b, (bit_count(xor(a.s0, b.s0)) + bit_count(xor(a.s1, b.s1)) + bit_count(xor(a.s2, b.s2)) + bit_count(xor(a.s3, b.s3)))::INTEGER AS distance FROM x a JOIN x b ON a.doc_id < b.doc_id
WHERE bit_count(xor(a.s0, b.s0))::INTEGER + bit_count(xor(a.s1, b.s1)) + bit_count(xor(a.s2, b.s2)) + bit_count(xor(a.s3, b.s3)) <= 15 UNION ALL SELECT rep, doc_id, 0 FROM c WHERE rep <> doc_id""")
def radius_join_banded(spark, d):
    """Documents whose text signatures differ in at most 15 of 256 bits, copies told as members of their class."""
    return search.self_radius_join(stored(text_corpus(spark, d), "signatures"), 15, 256)


B_FEATURES = FEATURES.replace("documents", "benchmark").replace("doc_id", "item_id").replace("tk ", "btk ").replace("FROM tk", "FROM btk").replace("ts AS", "bts AS").replace("FROM ts", "FROM bts").replace("ft AS", "bft AS")
B_HASHES = hashes(256).replace("doc_id", "item_id").replace("FROM ft", "FROM bft").replace("hm AS", "bhm AS").replace("FROM hm", "FROM bhm").replace("hs AS", "bhs AS").replace("FROM hs", "FROM bhs").replace("cp AS", "bcp AS")
B_ALL = "bac AS (SELECT item_id, pos, value FROM bcp UNION ALL SELECT item_id, 0, 0 FROM benchmark)"
HAM4 = " + ".join(f"bit_count(xor(x.s{w}, y.s{w}))::INTEGER" for w in range(4))


@register(f"""WITH {FEATURES}, {hashes(256)}, {ALL_CP}, {B_FEATURES}, {B_HASHES}, {B_ALL}, x AS {packed('bac', 'item_id', False)}, y AS {packed('ac', 'doc_id', False)},
r AS (SELECT item_id AS query_id, doc_id AS doc_idx, ({HAM4})::INTEGER AS distance, row_number() OVER (PARTITION BY item_id ORDER BY {HAM4}, doc_id)::INTEGER AS rank FROM x, y)
SELECT * FROM r WHERE rank <= 5""")
def text_knn(spark, d):
    q = embed.text_signature(table(spark, d, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), *[F.col(f"s{w}").alias(f"q{w}") for w in range(4)])
    return search.knn_join(q, text_corpus(spark, d), 5, 256)


@register("""
WITH m AS (SELECT i, j, CASE WHEN substr(md5('7|' || i || '|' || j), 9, 1) >= '8' THEN 1.0 ELSE -1.0 END AS s FROM range(0, 256) a(i), range(0, 64) b(j)),
r AS (SELECT i, list(s ORDER BY j) AS s FROM m GROUP BY i)
SELECT vec_id AS doc_idx, sum(CASE WHEN list_inner_product(embedding::DOUBLE[], s::DOUBLE[]) >= 0 THEN 1 ELSE 0 END)::INTEGER AS ones FROM embeddings, r GROUP BY vec_id""")
def random_projection_sig(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_idx"), "embedding")
    p = embed.project(e, "embedding", embed.random_projection(64, 256))
    s = S.with_signature(p.select("doc_idx", "projected"), "projected", 256)
    return s.select("doc_idx", sum((F.bit_count(f"s{w}") for w in range(1, 4)), F.bit_count("s0")).alias("ones"))


@register(f"""
WITH tk AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS token FROM benchmark),
ps AS (SELECT token, pos, row_number() OVER (PARTITION BY token ORDER BY md5('7|' || token || '|' || pos), pos) AS k FROM (SELECT DISTINCT token FROM tk), range(0, 256) t(pos)),
sm AS (SELECT item_id, pos, sum(CASE WHEN k <= 8 THEN 1 ELSE -1 END) AS value FROM tk JOIN ps USING (token) WHERE k <= 16 GROUP BY item_id, pos)
SELECT * FROM {packed('sm', 'item_id', True)}""")
def random_index_sig(spark, d):
    occ = table(spark, d, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return embed.random_index_signature(occ, embed.random_index_base(occ), "item_id")


# --- catalogue -------------------------------------------------------------------------------------------------------


@register("SELECT (row_number() OVER (ORDER BY name) - 1)::INTEGER AS event_id, name FROM (SELECT DISTINCT coalesce(source, '_default') AS name FROM documents)")
def event_dim(spark, d):
    return catalog.event_dim(table(spark, d, "documents"), "source")


@register("WITH e AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS event_id FROM (SELECT DISTINCT coalesce(source, '_default') AS name FROM documents)) SELECT doc_id AS doc_idx, event_id::INTEGER AS event_id FROM documents JOIN e ON name = coalesce(source, '_default')")
def doc_event(spark, d):
    c = table(spark, d, "documents").withColumnRenamed("doc_id", "doc_idx")
    return catalog.doc_event(c, catalog.event_dim(c, "source"), "source")


@register("SELECT vec_id AS doc_idx FROM embeddings WHERE label IN (0, 2)")
def scope_union(spark, d):
    return catalog.scope(vector_bridge(spark, d), [2, 0, 2])


@register(f"WITH {V}, {DIM} SELECT event_id::INTEGER AS event_id, doc_idx // 65536 AS block, list(doc_idx ORDER BY doc_idx) AS rows FROM b GROUP BY 1, 2")
def event_rows(spark, d):
    return catalog.inverted_list(vector_bridge(spark, d))


@register("SELECT (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS event_id, count(*) AS rows FROM events GROUP BY event_type HAVING count(*) >= 1024")
def warm_events(spark, d):
    """Events with enough rows that an index of their own is worth its cost."""
    t = turns(spark, d)
    return catalog.worth_keeping(t.select(F.col("seq").alias("doc_idx"), "event_id"))


@register("SELECT count(DISTINCT k) AS keys, count(*) AS rows FROM (SELECT conv_id, list_sort(list_distinct(list(role))) AS k FROM conversations GROUP BY conv_id)")
def scope_hash_sets(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return c.agg(F.count_distinct(catalog.scope_key(F.col("r"))).alias("keys"), F.count(F.lit(1)).alias("rows"))


# --- prediction ------------------------------------------------------------------------------------------------------

TURNS = """e AS (SELECT name, (row_number() OVER (ORDER BY name) - 1)::INTEGER AS event_id FROM (SELECT DISTINCT event_type AS name FROM events)),
t AS (SELECT user_id AS session, ts, events.event_id AS seq, e.event_id AS ev FROM events JOIN e ON e.name = event_type),
h AS (SELECT *, list(ev) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS hist FROM t)"""
TRANS = f"""{TURNS}, x AS (SELECT o AS ord, hist[len(hist) - o + 1 : len(hist)] AS context, ev AS next FROM h, range(1, 4) r(o) WHERE len(hist) >= o),
m AS (SELECT ord::INTEGER AS ord, context, next, count(*)::DOUBLE AS weight FROM x GROUP BY 1, 2, 3)"""


def trained(spark, d) -> DataFrame:
    return markov.transitions(turns(spark, d))


@register(f"WITH {TRANS} SELECT * FROM m WHERE ord = 1")
def markov_transitions(spark, d):
    return markov.transitions(turns(spark, d), markov.MarkovOptions(1))


@register(f"WITH {TRANS} SELECT * FROM m WHERE ord = 2")
def markov_order2(spark, d):
    return trained(spark, d).where("ord = 2")


@register(f"WITH {TRANS} SELECT * FROM m WHERE ord = 3")
def markov_order3(spark, d):
    return trained(spark, d).where("ord = 3")


@register(f"""WITH {TURNS}, p AS (SELECT hist[len(hist)] AS prev, ev AS next, ts FROM h WHERE len(hist) >= 1), z AS (SELECT max(ts) AS t FROM events)
SELECT prev, next, round(sum(2 ** (-((epoch_us(z.t) - epoch_us(p.ts)) / 1e6) / 86400.0)), 6) AS weight FROM p, z GROUP BY prev, next""")
def markov_decay(spark, d):
    t = turns(spark, d)
    end = t.agg(F.max("ts")).first()[0]
    m = markov.transitions(t, markov.MarkovOptions(1, half_life_s=86_400.0), F.lit(end).cast("timestamp"))
    return m.select(F.col("context")[0].alias("prev"), "next", F.round("weight", 6).alias("weight"))


@register(f"WITH {TRANS} SELECT ord, context, sum(weight) AS total FROM m GROUP BY ord, context")
def markov_totals(spark, d):
    return markov.totals(trained(spark, d))


HISTORIES = "SELECT session AS query_id, hist FROM (SELECT session, list(ev ORDER BY ts, seq) AS hist FROM t GROUP BY session)"


def predict_sql(histories: str, k: int) -> str:
    return f"""WITH {TRANS}, q AS ({histories}), v AS (SELECT DISTINCT ev AS next FROM t), n AS (SELECT count(*) AS n FROM v),
tot AS (SELECT ord, context, sum(weight) AS total FROM m GROUP BY ord, context HAVING sum(weight) >= 2),
sx AS (SELECT query_id, o::INTEGER AS ord, hist[len(hist) - o + 1 : len(hist)] AS context FROM q, range(1, 4) r(o) WHERE len(hist) >= o),
best AS (SELECT query_id, ord, context, total FROM (SELECT sx.*, total, row_number() OVER (PARTITION BY query_id ORDER BY sx.ord DESC) AS rn FROM sx JOIN tot ON sx.ord = tot.ord AND sx.context = tot.context) WHERE rn = 1),
sc AS (SELECT q.query_id, v.next AS event_id, coalesce(best.ord, 0) AS ord, CASE WHEN best.ord IS NULL THEN 1.0 / n.n ELSE (coalesce(m.weight, 0) + 0.01) / (best.total + 0.01 * n.n) END AS p
  FROM q CROSS JOIN v CROSS JOIN n LEFT JOIN best ON best.query_id = q.query_id LEFT JOIN m ON m.ord = best.ord AND m.context = best.context AND m.next = v.next)
SELECT query_id, event_id, ord::INTEGER AS ord, round(p, 6) AS probability, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, event_id)::INTEGER AS rank FROM sc) WHERE rank <= {k}"""


def _predicted(spark, d, queries: DataFrame, k: int) -> DataFrame:
    t = turns(spark, d)
    return markov.predict(queries, markov.transitions(t), markov.vocabulary(t), k).select("query_id", "event_id", "ord", F.round("probability", 6).alias("probability"), "rank")


@register(predict_sql(HISTORIES, 3))
def markov_topk(spark, d):
    t = turns(spark, d)
    s = t.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "event_id"))).alias("x"))
    return _predicted(spark, d, s.select(F.col("session").alias("query_id"), markov.last_n(F.transform("x", lambda x: x["event_id"]), 3).alias("history")), 3)


@register(predict_sql(HISTORIES, 3).replace("SELECT query_id, event_id, ord", "SELECT query_id, rank, (SELECT name FROM e WHERE e.event_id = z.event_id) AS name FROM (SELECT query_id, event_id, ord") + ") z WHERE event_id <> 2")
def predicted_names(spark, d):
    """Names of the predicted events, without those that the catalogue doesn't know; here it lacks one."""
    t = turns(spark, d)
    known = t.select(F.col("event_id"), F.col("event").alias("name")).distinct().where("event_id <> 2")
    return catalog.event_names(markov_topk(spark, d), known).select("query_id", "rank", "name")


BACKOFF = [(1, [0, 99, 1]), (2, [77]), (3, []), (4, [99, 2, 3]), (5, [4, 4, 4])]


@register(predict_sql("SELECT * FROM (VALUES " + ", ".join(f"({i}, {h}::INTEGER[])" for i, h in BACKOFF) + ") b(query_id, hist)", 4))
def markov_backoff(spark, d):
    return _predicted(spark, d, spark.createDataFrame(BACKOFF, "query_id int, history array<int>"), 4)


@register(f"WITH {TURNS} SELECT event_id, round(1.0 / (SELECT count(*) FROM e), 6) AS probability FROM e")
def markov_uniform(spark, d):
    return _predicted(spark, d, spark.createDataFrame([(1, [10**6])], "query_id int, history array<int>"), 100).select("event_id", "probability")


@register(f"WITH {TURNS} SELECT DISTINCT ev AS event_id FROM t")
def vocab(spark, d):
    return markov.vocabulary(turns(spark, d))


@register(f"WITH {TURNS} SELECT session, list(ev ORDER BY ts, seq) AS events FROM t GROUP BY session HAVING count(*) >= 2")
def session_sequences(spark, d):
    return markov.sequences(turns(spark, d), "event_id")


@register(f"WITH {TURNS} SELECT session, seq, coalesce(hist, []) AS last3 FROM h")
def last_n_context(spark, d):
    return markov.contexts(turns(spark, d), 3).select("session", "seq", F.col("history").alias("last3"))


@register(f"""WITH {TURNS}, w AS (SELECT session, seq, ts, list({{'at': ts, 'ev': ev}}) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS items FROM t)
SELECT session, seq, list_transform(list_filter(items, lambda x: epoch_us(ts) - epoch_us(x.at) <= 3600000000), lambda x: x.ev) AS recent FROM w""")
def context_age_window(spark, d):
    return markov.recent(turns(spark, d), 8, 3600.0).select("session", "seq", F.col("window").alias("recent"))


SR = f"""{TURNS}, pr AS (SELECT hist[len(hist)] AS source, ev AS target, count(*) AS n FROM h WHERE len(hist) >= 1 GROUP BY 1, 2),
tm AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS p FROM pr),
pw AS (SELECT 0 AS k, n AS source, n AS target, 1.0::DOUBLE AS value FROM (SELECT source AS n FROM tm UNION SELECT target FROM tm)
  UNION ALL SELECT any_value(a.k) + 1, a.source, b.target, sum(a.value * b.p * 0.9) FROM pw a JOIN tm b ON a.target = b.source WHERE a.k < 320 GROUP BY a.source, b.target),
sr AS (SELECT source, target, sum(value) AS value FROM pw GROUP BY 1, 2)"""


@register(f"WITH RECURSIVE {SR} SELECT source, target, round(value, 6) AS value FROM sr")
def sr_closed_form(spark, d):
    """The SQL adds up 320 powers, of which what is left out is below 1e-13 of a row's sum."""
    return successor.closed_form(successor.transition_matrix(turns(spark, d))).select("source", "target", F.round("value", 6).alias("value"))


@register(f"""WITH RECURSIVE {SR}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY greatest(value, 0) DESC, target) AS rank FROM sr WHERE source <> target)
SELECT source, rank::INTEGER AS rank, target, round(greatest(value, 0) / sum(greatest(value, 0)) OVER (PARTITION BY source), 6) AS probability FROM r WHERE rank <= 3""")
def sr_predict(spark, d):
    m = successor.closed_form(successor.transition_matrix(turns(spark, d)))
    return successor.predict(m, 3).select("source", "rank", "target", F.round("probability", 6).alias("probability"))


@register()
def sr_td0(spark, d):
    return successor.train_td0(turns(spark, d)).select("session", "source", "target", F.round("value", 6).alias("value"))


def _last_event(spark, d) -> DataFrame:
    return turns(spark, d).groupBy("session").agg(F.max_by("event_id", F.struct("ts", "seq")).alias("last"), F.count(F.lit(1)).alias("turns"))


@register()
def hybrid_predict(spark, d):
    """SR where a session has half the warm-up of 50 transitions, else the trained Markov tables."""
    t, last = turns(spark, d), _last_event(spark, d)
    sr = successor.predict(successor.train_td0(t), 3, ["session"])
    sure = last.where((F.col("turns") - 1) / 50 >= 0.5)
    from_sr = sr.join(sure, (sr["session"] == sure["session"]) & (sr["source"] == sure["last"])).select(sr["session"], "rank", F.col("target").alias("event_id"), "probability", F.lit("sr").alias("by"))
    rest = last.join(from_sr.select("session").distinct(), "session", "left_anti").select(F.col("session").alias("query_id"), F.array("last").alias("history"))
    p = markov.predict(rest, markov.transitions(t, markov.MarkovOptions(1)), markov.vocabulary(t), 3, alpha=1.0, max_order=1)
    return from_sr.unionByName(p.select(F.col("query_id").alias("session"), "rank", "event_id", "probability", F.lit("markov").alias("by"))).withColumn("probability", F.round("probability", 6))


@register()
def lowrank_predict(spark, d):
    """Low-rank SR over label centroids of the embeddings, trained on the transitions of all sessions of events (event i has the centroid of label i)."""
    v = vectors(spark, d).withColumn("event_id", F.col("event").cast("int"))
    n, s, x = successor.bit_statistics(v, 64)
    mean, w, _ = successor.principal_components(n, s, x, 16)
    m = successor.LowRankSR(16, 64, projection=w, mean=mean)
    for r in embed.majority_signature(v, "event_id", 64).orderBy("event_id").collect():  # one row an event
        m.set_centroid(r["event_id"], successor.unpack(np.array([[r["s0"]]]))[0])
    pairs = markov.transitions(turns(spark, d), markov.MarkovOptions(1)).select(F.col("context")[0].alias("event_id"), "next", F.col("weight").cast("bigint").alias("n")).orderBy("event_id", "next")
    m.observe_counts([(r["event_id"], r["next"], r["n"]) for r in pairs.collect()])  # at most the square of the number of events
    rows = [(e, i + 1, t, float(round(p, 6))) for e in sorted(m.features) for i, (t, p) in enumerate(m.predict([e], 3))]
    return spark.createDataFrame(rows, "source int, rank int, target int, probability double")


@register("SELECT i::INTEGER AS bit, round(avg(CASE WHEN embedding[i + 1] >= 0 THEN 1.0 ELSE 0.0 END), 6) AS mean FROM embeddings, range(0, 64) t(i) GROUP BY i")
def pca_mean(spark, d):
    n, s, _ = successor.bit_statistics(vectors(spark, d), 64)
    return spark.createDataFrame([(i, float(round(x / max(n, 1), 6))) for i, x in enumerate(s)], "bit int, mean double")


@register("""WITH b AS (SELECT vec_id, i, CASE WHEN embedding[i + 1] >= 0 THEN 1.0::DOUBLE ELSE 0.0 END AS x FROM embeddings, range(0, 64) t(i)), mu AS (SELECT i, avg(x) AS m FROM b GROUP BY i)
SELECT a.i::INTEGER AS bit, c.i::INTEGER AS other, round(avg(a.x * c.x) - any_value(ma.m * mc.m), 6) AS cov FROM b a JOIN b c ON a.vec_id = c.vec_id AND a.i <= c.i JOIN mu ma ON ma.i = a.i JOIN mu mc ON mc.i = c.i GROUP BY 1, 2""")
def pca_covariance(spark, d):
    n, s, x = successor.bit_statistics(vectors(spark, d), 64)
    c = x / n - np.outer(s / n, s / n)
    return spark.createDataFrame([(i, j, float(round(c[i, j], 6) + 0.0)) for i in range(64) for j in range(i, 64)], "bit int, other int, cov double")


@register()
def pca_components(spark, d):
    n, s, x = successor.bit_statistics(vectors(spark, d), 64)
    _, w, values = successor.principal_components(n, s, x, 8)
    return spark.createDataFrame([(k, i, float(round(w[i, k], 6)), float(round(values[k], 6))) for k in range(8) for i in range(64)], "component int, bit int, loading double, eigenvalue double")


@register(f"""WITH {V}, o AS (SELECT label, i, sum(get_bit(s, i::INTEGER)) AS c, count(*) AS n FROM v, range(0, 64) t(i) GROUP BY label, i),
z AS (SELECT label, sum(CASE WHEN c * 2 >= n THEN (2::HUGEINT ** (63 - i))::HUGEINT ELSE 0 END)::HUGEINT AS w FROM o GROUP BY label)
SELECT label::VARCHAR AS event, (CASE WHEN w >= 9223372036854775808::HUGEINT THEN w - 18446744073709551616::HUGEINT ELSE w END)::BIGINT AS s0 FROM z""")
def event_centroids(spark, d):
    return embed.majority_signature(vectors(spark, d), "event", 64)


@register("""WITH o AS (SELECT label, i, CASE WHEN 2 * sum(CASE WHEN embedding[i + 1] >= 0 THEN 1 ELSE 0 END) >= count(*) THEN 1.0::DOUBLE ELSE 0.0 END AS x FROM embeddings, range(0, 64) t(i) GROUP BY label, i), mu AS (SELECT i, avg(x) AS m FROM o GROUP BY i)
SELECT a.i::INTEGER AS bit, c.i::INTEGER AS other, round(avg(a.x * c.x) - any_value(ma.m * mc.m), 6) AS cov FROM o a JOIN o c ON a.label = c.label AND a.i <= c.i JOIN mu ma ON ma.i = a.i JOIN mu mc ON mc.i = c.i GROUP BY 1, 2""")
def centroid_pca_covariance(spark, d):
    """The covariance that the centroid variant of the low-rank projection takes its components from."""
    n, s, x = successor.bit_statistics(embed.majority_signature(vectors(spark, d), "event", 64), 64)
    c = x / n - np.outer(s / n, s / n)
    return spark.createDataFrame([(i, j, float(round(c[i, j], 6) + 0.0)) for i in range(64) for j in range(i, 64)], "bit int, other int, cov double")


# --- sessions --------------------------------------------------------------------------------------------------------

GATE = f"""{V}, o AS (SELECT label, s, row_number() OVER (PARTITION BY label ORDER BY doc_idx) AS r, doc_idx FROM v)"""
GATE_REC = f"""WITH RECURSIVE {GATE}, g AS (
  SELECT label, r, doc_idx, s AS last, true AS emitted FROM o WHERE r = 1
  UNION ALL SELECT o.label, o.r, o.doc_idx, CASE WHEN bit_count(xor(g.last, o.s)) >= 30 THEN o.s ELSE g.last END, bit_count(xor(g.last, o.s)) >= 30 FROM g JOIN o ON o.label = g.label AND o.r = g.r + 1)"""


def gated(spark, d) -> DataFrame:
    """(event, doc_idx, emitted): the drift gate over each event's signatures in order."""
    return live.gate(vectors(spark, d), "event", "doc_idx", 64, 30)


@register(f"{GATE_REC} SELECT label::VARCHAR AS event, doc_idx, emitted FROM g")
def drift_gate(spark, d):
    return gated(spark, d)


@register(f"{GATE_REC} SELECT label::VARCHAR AS event, count(*) AS observed, sum(emitted::INTEGER)::BIGINT AS emitted, round(sum((NOT emitted)::INTEGER) / count(*), 6) AS suppression FROM g GROUP BY label")
def gate_stats(spark, d):
    g = gated(spark, d).groupBy("event").agg(F.count(F.lit(1)).alias("observed"), F.count_if("emitted").alias("emitted"))
    return g.withColumn("suppression", F.round(metrics.ratio(F.col("observed") - F.col("emitted"), F.col("observed")), 6))


def _replayed(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("source").alias("event"))
    corpus = text_corpus(spark, d).join(catalog.doc_event(docs, catalog.event_dim(docs)), "doc_idx")
    return live.replay(utterances(spark, d), corpus).drop("model")


@register()
def session_replay(spark, d):
    return _replayed(spark, d)


@register()
def served_by_tally(spark, d):
    return metrics.tally(_replayed(spark, d).where("served_by <> 'warm'"))


@register()
def delta_cache_log(spark, d):
    """Finalized turns that were answered from the cache or a speculation, with the size of their scope."""
    return _replayed(spark, d).where("served_by IN ('delta_cache', 'speculative')").select("session", "seq", "served_by", "scope_size", F.size("doc_ids").alias("hits"))


@register(f"""WITH {V}, {DIM}, bk AS (SELECT b.event_id, min(bit_count(xor(v.s, w.s))) AS best, w.doc_idx AS q FROM v JOIN b USING (doc_idx), v w WHERE w.doc_idx % 100 = 0 GROUP BY b.event_id, w.doc_idx),
al AS (SELECT q, min(best) AS best FROM bk GROUP BY q)
SELECT al.q AS query_id, (min(CASE WHEN event_id IN (0, 1, 2) THEN bk.best END) = any_value(al.best)) AS warm_hit FROM bk JOIN al USING (q) GROUP BY al.q""")
def prefetch_warm_hits(spark, d):
    """Whether the best distance within the prefetched events 0, 1, 2 is the best of all, for every query."""
    v, b, q = vectors(spark, d).select("doc_idx", "s0"), vector_bridge(spark, d), asked(spark, d)
    best = lambda c, name: search.knn_join(q, c, 1, 64).select("query_id", F.col("distance").alias(name))
    warm = best(v.join(catalog.scope(b, [0, 1, 2]), "doc_idx", "left_semi"), "warm")
    return best(v, "cold").join(warm, "query_id", "left").select("query_id", F.coalesce(F.col("warm") == F.col("cold"), F.lit(False)).alias("warm_hit"))


REQUESTS = """SELECT conv_id::VARCHAR AS session, turn::BIGINT AS seq, CASE WHEN role = 'user' THEN 'finalize' WHEN role = 'assistant' THEN 'warm' ELSE 'reset' END AS action,
CASE WHEN role = 'user' THEN text END AS query, CASE WHEN role = 'user' THEN CASE WHEN trim(text) = '' THEN 400 ELSE 200 END ELSE 200 END AS status FROM conversations"""


@register(f"SELECT session, seq, CASE WHEN status = 200 THEN action END AS action, CASE WHEN status = 200 THEN query END AS text, CASE WHEN status = 200 AND action = 'finalize' THEN 5 WHEN status = 200 THEN 10 END AS k, status FROM ({REQUESTS})")
def routed_requests(spark, d):
    """Conversations as requests to a service: users' turns ask for completions, others' warm or reset their session."""
    c, role = table(spark, d, "conversations"), F.col("role")
    session = F.col("conv_id").cast("string")
    asked = F.to_json(F.struct(session.alias("user"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")))
    path = F.when(role == "user", "/v1/chat/completions").otherwise(F.concat(F.lit("/session/"), session, F.when(role == "assistant", "/warm").otherwise("/reset")))
    rows = c.select(F.col("turn").cast("bigint").alias("seq"), F.timestamp_seconds("turn").alias("ts"), F.lit("POST").alias("method"), path.alias("path"), F.when(role == "user", asked).alias("body"), session.alias("sender"))
    got = requests.routed(rows)
    return got.select(F.col("sender").alias("session"), "seq", "action", "text", "k", "status")


# --- cold tier -------------------------------------------------------------------------------------------------------


def cold_store(spark, d) -> DataFrame:
    v = vectors(spark, d)
    return v.select(F.col("doc_idx").alias("insert_seq"), "s0", cold.pack_value(F.col("event").cast("int"), F.col("doc_idx")).alias("value"))


@register(f"WITH {VQ} {ranked('SELECT query_id, doc_idx AS insert_seq, distance, label::BIGINT AS event_id, doc_idx FROM d', 7)}")
def cold_nearest(spark, d):
    return cold.nearest_of(asked(spark, d), cold_store(spark, d), 7, 64)


@register(f"WITH {VQ} SELECT query_id, doc_idx AS insert_seq, distance, label::BIGINT AS event_id, doc_idx FROM d WHERE distance <= 22")
def cold_radius(spark, d):
    return cold.within_of(asked(spark, d), cold_store(spark, d), 22, 64)


@register("SELECT vec_id AS doc_idx, (label::BIGINT * 4294967296 + vec_id) AS value, label::BIGINT AS event_id, vec_id AS doc FROM embeddings")
def cold_pack_value(spark, d):
    event, doc = cold.unpack_value(F.col("value"))
    return cold_store(spark, d).select(F.col("insert_seq").alias("doc_idx"), "value", event.alias("event_id"), doc.alias("doc"))


@register(f"WITH {V}, r AS (SELECT doc_idx, distance FROM d ORDER BY distance, doc_idx LIMIT 5), c AS (SELECT doc_idx, distance FROM d WHERE distance <= 20) SELECT 'hot' AS tier, distance, doc_idx FROM r UNION ALL SELECT 'cold', distance, doc_idx FROM c")
def hot_and_cold(spark, d):
    q = first_query(spark, d)
    return cold.with_tier(search.top_k(vectors(spark, d), q, 5), cold.within(cold_store(spark, d), q, 20))


BITS = "bv AS (SELECT vec_id AS i, CASE WHEN embedding[1] >= 0 THEN 1 ELSE 0 END AS bit FROM embeddings)"


def _first_bits(spark, d) -> tuple[DataFrame, int]:
    """The first dimension's signs as a bit vector over vec_id, and its length."""
    s = cold_store(spark, d)
    return cold.bit_sliced(s, 64).where("bit = 0").select("word_idx", "word"), s.agg(F.max("insert_seq") + 1).first()[0]


@register(f"WITH {BITS}, n AS (SELECT max(i) + 1 AS n FROM bv), p AS (SELECT i FROM range(0, (SELECT max(vec_id) + 71 FROM embeddings)) t(i)) SELECT p.i, coalesce((SELECT sum(bit) FROM bv WHERE bv.i < p.i), 0)::BIGINT AS rank1, (SELECT least(p.i, n) FROM n) - coalesce((SELECT sum(bit) FROM bv WHERE bv.i < p.i), 0)::BIGINT AS rank0 FROM p")
def bit_rank(spark, d):
    v, n = _first_bits(spark, d)
    return cold.rank(v, spark.range(0, n + 70).withColumnRenamed("id", "i"), n)


@register(f"WITH {BITS}, o AS (SELECT i, row_number() OVER (ORDER BY i) AS j FROM bv WHERE bit = 1) SELECT k.j, o.i AS position FROM range(1, (SELECT max(vec_id) + 3 FROM embeddings)) k(j) LEFT JOIN o ON o.j = k.j")
def bit_select(spark, d):
    v, n = _first_bits(spark, d)
    return cold.select(v, spark.range(1, n + 2).withColumnRenamed("id", "j"), n)


@register(f"WITH {BITS}, o AS (SELECT i, row_number() OVER (ORDER BY i) AS j FROM bv WHERE bit = 0) SELECT k.j, o.i AS position FROM range(1, (SELECT max(vec_id) + 3 FROM embeddings)) k(j) LEFT JOIN o ON o.j = k.j")
def bit_select_zero(spark, d):
    v, n = _first_bits(spark, d)
    return cold.select(v, spark.range(1, n + 2).withColumnRenamed("id", "j"), n, ones=False)


# --- metrics and formatting --------------------------------------------------------------------------------------------


@register(f"""WITH {V}, r AS (SELECT x.doc_idx AS q, x.label AS target, y.label AS topic, row_number() OVER (PARTITION BY x.doc_idx ORDER BY bit_count(xor(x.s, y.s)), y.doc_idx) AS rank FROM v x, v y WHERE x.doc_idx % 100 = 0 AND x.doc_idx <> y.doc_idx),
g AS (SELECT q, any_value(target) AS target, list(topic ORDER BY rank) AS topics FROM r WHERE rank <= 5 GROUP BY q)
SELECT count(*) AS n, round(avg(CASE WHEN topics[1] = target THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN list_contains(topics, target) THEN 1.0 ELSE 0 END), 6) AS topk FROM g""")
def topic_correctness(spark, d):
    v = vectors(spark, d)
    near = search.knn_join(asked(spark, d), v.select("doc_idx", "s0"), 6, 64).where("query_id <> doc_idx")
    w = markov.Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("r", F.row_number().over(w)).where("r <= 5")
    e = v.select("doc_idx", F.col("event").alias("topic"))
    log = near.join(e, "doc_idx").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "topic"))).alias("t"))
    log = log.join(e.withColumnRenamed("doc_idx", "query_id").withColumnRenamed("topic", "target"), "query_id").select("target", F.transform("t", lambda x: x["topic"]).alias("topics"))
    return metrics.topic_correctness(log).select("n", F.round("top1", 6).alias("top1"), F.round("topk", 6).alias("topk"))


@register("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = least(c * 50 // 100, c - 1) THEN value END) AS p50, max(CASE WHEN i = least(c * 95 // 100, c - 1) THEN value END) AS p95, max(CASE WHEN i = least(c * 99 // 100, c - 1) THEN value END) AS p99, round(avg(value), 6) AS mean FROM n GROUP BY event_type""")
def latency_percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


DECIDED = "CASE event_type WHEN 'click' THEN 'speculative' WHEN 'view' THEN 'delta_cache' WHEN 'purchase' THEN 'warm' ELSE 'shard_scan' END"


@register(f"""WITH s AS (SELECT {DECIDED} AS w FROM events), c AS (SELECT count(*) FILTER (w <> 'warm') AS n, count(*) FILTER (w = 'speculative') AS a, count(*) FILTER (w = 'delta_cache') AS b, count(*) FILTER (w = 'shard_scan') AS z FROM s)
SELECT n AS finalized, a AS speculative, b AS delta_cache, z AS scanned, round(CASE WHEN n > 0 THEN a / n ELSE 0 END, 6) AS speculative_rate, round(CASE WHEN n > a THEN b / (n - a) ELSE 0 END, 6) AS cache_rate, round(CASE WHEN n > 0 THEN (n - z) / n ELSE 0 END, 6) AS hit_rate FROM c""")
def decision_stats(spark, d):
    """Ratios over a log of decisions, for which the events' types stand."""
    t = metrics.decision_stats(table(spark, d, "events").select(F.expr(DECIDED).alias("served_by")))
    return t.select("finalized", "speculative", "delta_cache", "scanned", *[F.round(x, 6).alias(x) for x in ("speculative_rate", "cache_rate", "hit_rate")])


@register("SELECT event_type AS served_by, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY event_type")
def event_tally(spark, d):
    t = metrics.tally(table(spark, d, "events").select(F.col("event_type").alias("served_by")))
    return t.withColumn("percent", F.round("percent", 6))


@register("SELECT n::INTEGER AS n, round(rate, 6) AS rate FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS rate FROM events) WHERE n IN (200, 500, 1000)")
def running_hit_rate(spark, d):
    e = table(spark, d, "events").withColumn("hit", F.col("event_type") == "click")
    return metrics.running_rate(e, "event_id", "hit", [200, 500, 1000]).withColumn("rate", F.round("rate", 6))


@register("SELECT count(*) AS requests, sum(n_chars)::BIGINT AS total_us, ((sum(n_chars) // 1000) // greatest(count(*), 1))::BIGINT AS mean_ms FROM documents")
def server_stats(spark, d):
    return metrics.server_stats(table(spark, d, "documents"), "n_chars")


@register(f"""WITH {V}, h AS (SELECT doc_idx, distance, label, row_number() OVER (ORDER BY distance, doc_idx) AS rank FROM d)
SELECT string_agg('[' || rank || '] (' || label || ') ' || doc_idx, chr(10) ORDER BY rank) AS context FROM h WHERE rank <= 5""")
def format_context(spark, d):
    hits = search.top_k(vectors(spark, d), first_query(spark, d), 5).join(vectors(spark, d).select("doc_idx", "event"), "doc_idx")
    x = F.struct("distance", F.col("doc_idx").alias("id"), "event", F.lit(None).cast("string").alias("text"))
    return hits.agg(F.array_sort(F.collect_list(x)).alias("hits")).select(T.context_lines(F.col("hits")).alias("context"))


@register("SELECT conv_id, arg_max(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING trim(arg_max(text, turn)) <> ''")
def latest_user_message(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("message"))
    return c.where(F.trim("message") != "")


@register("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS session_id FROM pages")
def sanitize_session_id(spark, d):
    return table(spark, d, "pages").select("page_id", T.sanitised(F.col("url")).alias("session_id"))


@register("SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INTEGER AS words FROM conversations")
def usage_word_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("words"))


@register("SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 4")
def min_chars_guard(spark, d):
    return table(spark, d, "conversations").where(T.long_enough(F.col("text"))).select("conv_id", "turn")
