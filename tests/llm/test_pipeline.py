import pytest

import corpus_pipeline as C
from tables import SF
from parley.llm import common, decontaminate, ngram_join, pieces, toxicity


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's input and output over the small tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        got = common.materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, got))
        docs = got
    return out


def test_order_and_columns(steps, spark):
    assert [n for n, *_ in steps] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "sentencepiece"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for _, _, after in steps[:-1])


def test_toxic_documents_go_and_others_stay(steps, spark):
    _, before, after = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = {r["doc_id"] for r in toxicity.score(before, toxicity.train(before, labels)).where("toxic").collect()}
    assert ids(after) == [i for i in ids(before) if i not in found]
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    # 87 labels teach little, yet most toxic documents go, and clean ones stay
    assert len(toxic & set(ids(after))) < 0.5 * len(toxic) and len(clean - set(ids(after))) <= 0.02 * len(clean)


def test_exact_copies(steps):
    _, before, after = steps[1]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    assert ids(after) == sorted(first.values())


def test_one_of_each_group_of_near_copies(steps):
    from test_ngram_join import brute

    _, before, after = steps[2]
    pairs = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    parent = {i: i for i in ids(before)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert ids(after) == sorted(i for i in parent if root(i) == i)
    assert not ngram_join.similar_pairs(after).count()


def test_benchmark_passages(steps, spark):
    _, before, after = steps[3]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    gone = {r["doc_id"] for r in decontaminate.contaminated(before, bench).collect()}
    assert ids(after) == [i for i in ids(before) if i not in gone]
    texts = [r["text"].lower() for r in bench.collect()]
    assert not [r for r in after.collect() if any(t in r["text"].lower() for t in texts if len(t.split()) >= 8)]


def test_encoding(steps):
    _, before, after = steps[4]
    library = pieces.Vocabulary(pieces.MODEL).library
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    got = after.collect()
    assert len(got) == len(text) and all(r["ids"] == library.encode(text[r["doc_id"]]) and r["agrees"] for r in got)


def test_run_is_the_stages(steps, spark):
    assert ids(C.run(spark, SF)) == ids(steps[-1][2])


def test_odd_documents(docs_of, spark, english):
    """Null and empty texts, null ids and repeated rows pass every stage."""
    base = english(1, 80)
    docs = docs_of([(1, base), (2, base), (3, None), (4, ""), (None, english(2, 50)), (5, base + " end"), (6, english(3, 80)), (6, english(3, 80))])
    for name, stage in C.STAGES[:-1]:
        columns = docs.columns
        docs = common.materialise(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns == columns
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in C.STAGES[-1][1](spark, docs, SF).collect())
    assert got == [(False, 1), (False, 3), (False, 4), (False, 6), (True, None)]
    empty = docs_of([])
    for name, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0
