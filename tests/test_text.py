import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import embed


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokens(spark):
    assert one(spark, "Hello, World! 123 -- foo_bar.", T.tokens) == ["hello", "world", "123", "foo", "bar"]
    assert one(spark, "Ärger  naïve", T.tokens) == ["ärger", "naïve"]
    assert one(spark, "", T.tokens) == [] and one(spark, None, T.tokens) is None


def test_stop_words_and_bigrams(spark):
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS))
    w = lambda t: T.without_stop_words(T.tokens(t))
    assert one(spark, "the dog bites the dog", w) == ["dog", "bites", "dog"]
    assert one(spark, "the dog bites the dog", lambda t: T.bigrams(w(t))) == ["dog_bites", "bites_dog"]
    assert one(spark, "dog", lambda t: T.bigrams(w(t))) == []


def cosine(a, b):
    return sum(v * b.get(k, 0) for k, v in a.items()) / (sum(v * v for v in a.values()) ** 0.5 * sum(v * v for v in b.values()) ** 0.5)


def test_word_order_shows_in_bigrams_only(spark):
    df = spark.createDataFrame([(1, "dog bites man"), (2, "man bites dog")], "k int, text string")
    for bigrams, same in ((False, True), (True, False)):
        v = {1: {}, 2: {}}
        for r in embed.hashed_components(df, "k", use_bigrams=bigrams).collect():
            v[r["k"]][r["pos"]] = r["value"]
        assert (abs(cosine(v[1], v[2]) - 1) < 1e-9) == same


def test_embeddings_have_length_one(spark):
    df = spark.createDataFrame([(1, "some words to embed"), (2, ""), (3, None)], "k int, text string")
    n = {r[0]: r[1] for r in embed.hashed_embedding(df, "k").groupBy("k").agg(F.sum(F.col("value") ** 2)).collect()}
    assert set(n) == {1} and abs(n[1] - 1) < 1e-9


def test_a_text_without_features_is_all_ones(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "the of")], "k int, text string")
    assert {tuple(r)[1:] for r in embed.text_signature(df, "k").collect()} == {(-1,) * 4}


def test_projection_checks_its_dimension(spark):
    df = spark.createDataFrame([([1.0, 0.0],)], "v array<double>")
    m = embed.random_projection(2, 64)
    assert np.allclose(embed.project(df, "v", m).first()["projected"], m @ [1, 0])
    with pytest.raises(PySparkException, match="expected 3 dimensions"):
        embed.project(df, "v", embed.random_projection(3, 64)).collect()


def test_embedder_protocol(spark):
    class Lengths:
        dim = 2

        def embed(self, texts):
            return np.array([[len(t), 1] for t in texts])

    df = spark.createDataFrame([("abc",), (None,), ("",)], "text string")
    assert [r[0] for r in embed.embed_with(df, Lengths(), batch=2).select("vector").collect()] == [[3, 1], [0, 1], [0, 1]]


def test_random_index(spark):
    occ = spark.createDataFrame([(1, "a"), (1, "b"), (2, "unknown")], "k int, token string")
    base = embed.random_index_base(occ.where("k = 1"))
    per = {r["token"]: (r["n"], r["s"], r["d"]) for r in base.groupBy("token").agg(F.count("*").alias("n"), F.sum("sign").alias("s"), F.count_distinct("pos").alias("d")).collect()}
    assert per == {"a": (16, 0, 16), "b": (16, 0, 16)}
    got = {r["k"]: tuple(r)[1:] for r in embed.random_index_signature(occ, base, "k").collect()}
    assert got[2] == (0, 0, 0, 0) and got[1] != got[2]
    with pytest.raises(ValueError):
        embed.random_index_base(occ, nonzero=3)


def test_majority_has_ties_as_ones(spark):
    df = spark.createDataFrame([("e", -1), ("e", 0), ("f", 0), ("f", 0), ("f", -1)], "event string, s0 bigint")
    assert {r[0]: r[1] for r in embed.majority_signature(df, "event", 64).collect()} == {"e": -1, "f": 0}


def test_context_lines_and_template(spark):
    rows = [([(3, "a", "pricing", "body"), (5, None, None, None)],)]
    df = spark.createDataFrame(rows, "hits array<struct<distance:int,id:string,event:string,text:string>>")
    line = lambda style: df.select(T.context_lines(F.col("hits"), style)).first()[0]
    assert line("numbered") == "[1] (pricing) body\n[2] (_default) ?"
    assert line("list") == "- [pricing] body\n- [_default] ?"
    assert line("ids") == "- [pricing] (id=a dist=3)\n- [_default] (id=? dist=5)"
    fill = lambda c: df.select(T.in_template(c, "Context: {context}.")).first()[0]
    assert fill(F.lit("x")) == "Context: x." and fill(F.lit("")) == "Context: (no relevant context found)."


@pytest.mark.parametrize("raw, safe", [("../../etc/passwd", ".._.._etc_passwd"), ("a/b", "a_b"), ("a\\b", "a_b")])
def test_sanitised(spark, raw, safe):
    assert one(spark, raw, T.sanitised) == safe


def test_hashes_in_batches_are_those_of_the_expressions(spark):
    """The Arrow kernel against the expressions that SQL states, feature by feature."""
    texts = ["The dog bites the Dog, and bites again", "", None, "the and of", "Ärger über naïve  ÇA 12 ab12", "one", "a b c " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for options in ({}, {"bands": 6, "seed": 3}, {"use_bigrams": False, "drop_stop_words": False}):
        bands, seed = options.get("bands", 4), options.get("seed", 7)
        f = df.select("k", F.explode(T.features(F.col("text"), options.get("use_bigrams", True), options.get("drop_stop_words", True))).alias("token"))
        h = T.hash_blocks(F.col("token"), seed, bands)
        f = f.select("k", *[x.alias(f"h{i}") for i, x in enumerate(h)]).select("k", F.explode(T.hashed([F.col(f"h{i}") for i in range(len(h))], 128, bands)).alias("h"))
        want = {(r[0], r[1]): r[2] for r in f.groupBy("k", F.col("h.pos").alias("pos")).agg(F.sum("h.sign")).collect()}
        got = {(r["k"], r["pos"]): r["value"] for r in embed.hashed_components(df, "k", dim=128, **options).collect()}
        assert got == want
        bits = {r["k"]: [r["s0"], r["s1"]] for r in embed.text_signature(df, "k", bits=128, **options).collect()}
        for k in range(len(texts)):
            on = [w & (1 << (63 - i % 64)) != 0 for i in range(128) for w in [bits[k][i // 64] & (2**64 - 1)]]
            assert on == [want.get((k, i), 0) >= 0 for i in range(128)]


def test_sql_functions(spark):
    from parley.functions import signature as S

    S.register_sql(spark)
    assert spark.sql("SELECT ham64(0, -1), ham64(5, 6), ham256(array(0, 1, 2, 3), array(0, 1, 2, -4))").first() == (64, 2, 64)


def test_embedders_behind_requests():
    calls = []

    def post(texts, timeout):
        calls.append((len(texts), timeout))
        if len(calls) == 1:
            raise ConnectionError("busy")
        return [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(len(texts)))]

    e = embed.RemoteEmbedder(post, 2, timeout_s=3, wait_s=0)
    assert e.embed(["a", "b", "c"]).tolist() == [[0, 1], [1, 1], [2, 1]] and calls == [(3, 3), (3, 3)]
    for items in ([], [{"index": 0, "embedding": [1.0]}], [{"index": 1, "embedding": [1.0, 2.0]}]):
        with pytest.raises(ValueError):
            embed.RemoteEmbedder(lambda *_: items, 2).embed(["a"])

    def down(*_):
        raise TimeoutError

    with pytest.raises(TimeoutError):
        embed.RemoteEmbedder(down, 2, retries=1, wait_s=0).embed(["a"])


def test_vectorised_md5_is_md5():
    """Tokens of all lengths around a block, as they lie in a slice of an array."""
    import hashlib

    import numpy as np
    import pyarrow as pa
    from parley.functions import hashing as H

    tokens = ["".join(chr(97 + (i * j) % 26) for j in range(i % 130)) for i in range(400)] + ["ä" * i for i in range(60)]
    for seed, bands in ((7, 4), (123456, 6), (7, 1)):
        got = H.digests(pa.array(["x", *tokens, "y"]).slice(1, len(tokens)), seed, bands)
        raw = [b"".join(hashlib.md5(f"{seed}|{b}|{t}".encode()).digest() for b in range(2)) for t in tokens]
        want = np.array([np.frombuffer(x, ">u4")[:bands] for x in raw])
        assert got.shape == want.shape and (got == want).all()
    assert H.digests(pa.array([], pa.string()), 7, 4).shape == (0, 4)


def test_memory_of_hashing_is_bounded(spark):
    """A batch of many words takes no more memory than some of them, and nothing is kept."""
    import tracemalloc

    import pyarrow as pa
    from parley import worker_cache
    from parley.functions import hashing as H

    words = pa.array([[f"w{i}-{j}" for j in range(1000)] for i in range(1500)])
    tracemalloc.start()
    try:
        H.signature_words(words, 256, stop=[])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 100 << 20
    assert not any(isinstance(k, tuple) and k[0] == "md5" for k in worker_cache())
    embed.text_signature(spark.createDataFrame([(1, "a b")], "k int, text string"), "k").collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_bigrams_are_counted_in_arrow(spark):
    """The counts of the expressions, also of empty and missing texts, and no row for each occurrence."""
    texts = ["The dog bites the Dog, and bites again", "", None, "the and of", "Ärger über naïve  ÇA 12 ab12", "one", "a_b c " * 300, "dog bites dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = df.select(F.explode(T.bigrams(T.without_stop_words(T.tokens(F.col("text"))))).alias("bigram")).groupBy("bigram").count()
    got = embed.bigram_counts(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert embed.bigram_counts(df.where("k < 0")).count() == 0
