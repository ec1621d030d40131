import json
import struct

import numpy as np
import pytest

from parley.operators import markov
from parley.sources import index_io as io

FAQ = [("f1", "How much does a plan cost", "pricing"), ("f2", "Is there a free trial period", "trial"), ("f3", "How do I get my money back", "refund"), ("f4", "Which plan is the cheapest", "pricing"), ("f5", "Something else entirely", None)]


@pytest.fixture(scope="module")
def corpus_file(tmp_path_factory):
    p = tmp_path_factory.mktemp("c") / "faq.jsonl"
    p.write_text("".join(json.dumps({"id": i, "text": t} | ({"event": e} if e else {})) + "\n\n" for i, t, e in FAQ))
    return str(p)


def test_corpus(spark, corpus_file):
    assert sorted(map(tuple, io.read_corpus(spark, corpus_file).collect())) == sorted(FAQ)


def test_bad_corpora(spark, tmp_path):
    bad, none = tmp_path / "bad.jsonl", tmp_path / "none.jsonl"
    bad.write_text('{"id": "a", "text": "b"}\n\nnot json\n')
    none.write_text("\n")
    with pytest.raises(io.CorpusError, match=":3: "):
        io.read_corpus(spark, str(bad))
    with pytest.raises(io.CorpusError, match="empty"):
        io.read_corpus(spark, str(none))


def test_transcripts_of_both_shapes(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"events": ["pricing", "trial"]}\n{"session": "d", "event": "pricing"}\n{"session": "d", "event": "support"}\n{"events": ["a"], "session": "d", "event": "x"}\n')
    t = io.read_transcripts(spark, str(p))
    got = sorted(tuple(r["events"]) for r in markov.sequences(t).collect())
    assert got == [("pricing", "support"), ("pricing", "trial")]
    p.write_text('{"session": "d"}\n')
    with pytest.raises(io.CorpusError, match=":1: "):
        io.read_transcripts(spark, str(p))


def test_signature_files(spark, tmp_path):
    raw = struct.pack(">8q", *range(-4, 4))
    p = tmp_path / "sig.bin"
    p.write_bytes(raw)
    df = io.read_signatures(spark, str(p))
    assert [tuple(r) for r in df.orderBy("doc_idx").collect()] == [(0, -4, -3, -2, -1), (1, 0, 1, 2, 3)]
    io.write_signatures(df, str(tmp_path / "out.bin"))
    assert (tmp_path / "out.bin").read_bytes() == raw
    assert io.signatures_from(spark, raw).count() == 2
    p.write_bytes(raw[:-1])
    with pytest.raises(io.CorpusError):
        io.read_signatures(spark, str(p))
    with pytest.raises(io.CorpusError):
        io.signatures_from(spark, b"")


def test_index_round_trip(spark, corpus_file, tmp_path):
    path = str(tmp_path / "index")
    io.build_index(io.read_corpus(spark, corpus_file), path)
    x = io.load_index(spark, path)
    assert [r["id"] for r in x["docs"].orderBy("doc_idx").collect()] == ["f1", "f2", "f3", "f4", "f5"]
    assert {r["name"] for r in x["events"].collect()} == {"_default", "pricing", "refund", "trial"}
    hits = io.query_index(spark, path, "How do I get my money back", 2).orderBy("rank").collect()
    assert hits[0]["id"] == "f3" and hits[0]["distance"] == 0 and hits[0]["event"] == "refund"
    response = json.loads(io.to_response(io.query_index(spark, path, "free trial", 3)).first()[0])
    assert [r["rank"] for r in response["results"]] == [1, 2, 3]
    said = json.loads(io.completion(io.query_index(spark, path, "free trial", 1), "free trial").first()[0])
    assert said["choices"][0]["message"]["content"].startswith("[1] (") and said["usage"]["prompt_tokens"] == 2
    with pytest.raises(io.CorpusError):
        io.query_index(spark, path, "  ")
    (tmp_path / "index/manifest.json").write_text(json.dumps(x["manifest"] | {"n_entries": 9}))
    (tmp_path / "index/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(io.CorpusError, match="9 entries"):
        io.load_index(spark, path)


def test_models_round_trip(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(8, 3))
    io.save_matrix(spark, m, str(tmp_path / "m"))
    assert np.array_equal(io.load_matrix(spark, str(tmp_path / "m"), 8), m)
    with pytest.raises(io.CorpusError):
        io.load_matrix(spark, str(tmp_path / "m"), 9)
    t = spark.createDataFrame([(1, [0], 1, 8.0), (2, [0, 1], 2, 4.0)], "ord int, context array<int>, next int, weight double")
    io.save_markov(t, str(tmp_path / "t"), half_life_s=10.0, elapsed_s=20.0)
    assert [tuple(r) for r in io.load_markov(spark, str(tmp_path / "t"), 1).collect()] == [(1, [0], 1, 2.0)]


def test_imports(spark, tmp_path):
    (tmp_path / "d" / "faq").mkdir(parents=True)
    (tmp_path / "d" / "faq" / "a.txt").write_text("one\ntwo")
    (r,) = io.import_corpus(spark, str(tmp_path / "d"), "files").collect()
    assert r["id"].endswith("faq/a.txt") and (r["text"], r["event"]) == ("one\ntwo", "faq")
    (tmp_path / "x.csv").write_text("k,t\n1,text\n2,\n")
    assert list(map(tuple, io.import_corpus(spark, str(tmp_path / "x.csv"), "csv", "k", "t", None, header=True).collect())) == [("1", "text", None)]
    with pytest.raises(io.CorpusError):
        io.import_corpus(spark, str(tmp_path / "x.csv"), "csv", "k", "t", None, header=True, comment="1")
