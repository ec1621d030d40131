"""Corpora, transcripts, signatures and indexes: reading and writing."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import signature as S
from parley.operators import catalog, embed


class CorpusError(ValueError):
    """A corpus, transcript or index that can't be read as one."""


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file through Hadoop's file systems."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, event) of JSON lines. Blank lines are skipped; a malformed line is an error that names the file's line, as is an empty corpus."""
    lines = spark.read.text(path, wholetext=False).select("value", F.input_file_name().alias("file"))
    parsed = lines.where(F.trim("value") != "").withColumn("j", F.from_json("value", "id string, text string, event string", {"mode": "PERMISSIVE"}))
    bad = parsed.where("j.id IS NULL OR j.text IS NULL").select("file", "value").first()
    if bad:
        # only now are lines numbered, in the one bad file
        with_no = spark.read.text(bad["file"], wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
        n = with_no.where(F.col("line") == bad["value"]).agg(F.min("n")).first()[0]
        raise CorpusError(f"{bad['file']}:{(n if n is not None else -1) + 1}: not a corpus entry")
    out = parsed.select("j.*")
    if out.isEmpty():
        raise CorpusError(f"{path}: empty corpus")
    return out


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, ts, seq, event) of JSON lines of two shapes: {"events": [...]} is a session of its own, {"session", "event"} a turn; `events` wins. A line that is neither is an error.

    Turns keep the order of the file through its line numbers, which need the file's
    lines in one task; give transcripts in many files to read them in parallel.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.trim("value") != "")
    j = files.withColumn("j", F.from_json("value", "events array<string>, session string, event string"))
    bad = j.where("j IS NULL OR (j.events IS NULL AND (j.session IS NULL OR j.event IS NULL))").select("file", "line").first()
    if bad:
        raise CorpusError(f"{bad['file']}:{bad['line'] + 1}: not a transcript line")
    ts = F.timestamp_seconds(F.lit(0))
    whole = j.where("j.events IS NOT NULL").select(F.concat_ws("#", "file", F.col("line").cast("string")).alias("session"), ts.alias("ts"), F.posexplode("j.events").alias("seq", "event"))
    turns = j.where("j.events IS NULL").select("j.session", ts.alias("ts"), F.col("line").alias("seq"), "j.event")
    return whole.unionByName(turns).withColumn("seq", F.col("seq").cast("bigint"))


def read_signatures(spark: SparkSession, path: str, bits: int = 256) -> DataFrame:
    """(doc_idx, s0, ...) of a file of packed signatures; its size must be a positive multiple of a signature's."""
    n = bits // 8
    raw = spark.read.format("binaryFile").load(path)
    bad = raw.where((F.col("length") == 0) | (F.col("length") % n != 0)).select("path", "length").first()
    if bad:
        raise CorpusError(f"{bad['path']}: {bad['length']} bytes aren't signatures of {n}")
    each = raw.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("length") / n) - 1)).alias("doc_idx"), "content")
    each = each.select("doc_idx", F.substring("content", F.col("doc_idx").cast("int") * n + 1, F.lit(n)).alias("raw"))
    return each.select("doc_idx", *S.from_bytes(F.col("raw"), bits))


def write_signatures(corpus: DataFrame, path: str, bits: int = 256) -> None:
    """One file of packed signatures in order of doc_idx, for other programs; Parquet is the engine's own form."""
    rows = corpus.orderBy("doc_idx").select(S.to_bytes(S.word_names(bits)).alias("raw"))
    spark = corpus.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    for r in rows.toLocalIterator(prefetchPartitions=True):  # streamed partition by partition into the single file
        out.write(bytearray(r["raw"]))
    out.close()


def signatures_from(spark: SparkSession, raw: bytes, bits: int = 256) -> DataFrame:
    """(doc_idx, s0, ...) of packed signatures in memory."""
    if not raw or len(raw) % (bits // 8):
        raise CorpusError(f"{len(raw)} bytes aren't signatures of {bits // 8}")
    words = np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, bits // 64)
    return spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "doc_idx bigint, " + ", ".join(f"{w} bigint" for w in S.word_names(bits)))


def numbered(df: DataFrame, by: list[str], name: str, path: str) -> DataFrame:
    """The rows with their places in the order of `by`, from 0, through a range-sorted copy in a folder: counts of its partitions shift their own numbering."""
    from pyspark.sql import Window

    spark = df.sparkSession
    df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_p")).write.mode("overwrite").parquet(path)
    ordered = spark.read.parquet(path)
    shift = ordered.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1
    return ordered.join(F.broadcast(shift), "_p").withColumn(name, place).drop("_p", "_before")


def import_corpus(spark: SparkSession, path: str, kind: str = "parquet", ident: str = "id", text: str = "text", event: str | None = "event", **options) -> DataFrame:
    """(id, text, event) of any source that Spark reads, by the names of its columns; rows without id or text are left out, an empty corpus is an error.

    With kind `files` every file under the path is an entry: its path, its text and
    the folder it lies in.
    """
    if kind == "files":
        rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("id"), F.col("value").alias("text"))
        out = rows.withColumn("event", F.element_at(F.split("id", "/"), -2))
    else:
        rows = spark.read.format(kind).options(**options).load(path)
        out = rows.select(F.col(ident).cast("string").alias("id"), F.col(text).cast("string").alias("text"), (F.col(event).cast("string") if event else F.lit(None).cast("string")).alias("event"))
    out = out.where("id IS NOT NULL AND text IS NOT NULL")
    if out.isEmpty():
        raise CorpusError(f"{path}: empty corpus")
    return out


def build_index(corpus: DataFrame, path: str, bits: int = 256, **options) -> None:
    """Writes an index folder of a corpus (id, text, event): `docs`, `signatures` partitioned by event_id, `events`, and a manifest.

    doc_idx is the place of the id in sorted order, so rebuilding gives the same index.
    """
    if bits % 64:
        raise CorpusError("bits must be a multiple of 64")
    spark = corpus.sparkSession
    docs = numbered(corpus, ["id", "text"], "doc_idx", f"{path}/_ordered").select("doc_idx", "id", "text", "event")
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    catalog.event_dim(docs).write.mode("overwrite").parquet(f"{path}/events")
    events = spark.read.parquet(f"{path}/events")
    sig = embed.text_signature(docs, "doc_idx", bits=bits, **options).join(catalog.doc_event(docs, events), "doc_idx")
    sig.write.mode("overwrite").partitionBy("event_id").parquet(f"{path}/signatures")
    manifest = {"bits": bits, "n_entries": docs.count(), "embedder": "hashed", "options": options}
    _put_text(spark, f"{path}/manifest.json", json.dumps(manifest))
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_ordered")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load_index(spark: SparkSession, path: str) -> dict:
    """{manifest, docs, signatures, events}; a count that isn't the manifest's is an error."""
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    out = {"manifest": manifest} | {k: spark.read.parquet(f"{path}/{k}") for k in ("docs", "signatures", "events")}
    n = out["signatures"].count()
    if n != manifest["n_entries"]:
        raise CorpusError(f"manifest has {manifest['n_entries']} entries, signatures {n}")
    return out


def query_index(spark: SparkSession, path: str, text: str, k: int = 5) -> DataFrame:
    """The k best entries for a text: rank, distance, doc_idx, id, text, event. A blank text is an error."""
    from parley.operators import search

    if not text.strip():
        raise CorpusError("empty query")
    x = load_index(spark, path)
    m = x["manifest"]
    row = embed.text_signature(spark.createDataFrame([(0, text)], "q int, text string"), "q", bits=m["bits"], **m["options"]).first()
    bridge = x["signatures"].select("doc_idx", "event_id")
    hits = search.hierarchical(x["signatures"], bridge, S.literal_words(row, m["bits"]), k)
    names = bridge.join(x["events"], "event_id").select("doc_idx", F.col("name").alias("event"))
    return search.render(hits.select("doc_idx", "distance"), x["docs"].select("doc_idx", "id", "text"), names)


def save_matrix(spark: SparkSession, matrix: np.ndarray, path: str) -> None:
    """A projection matrix as rows (bit, weights)."""
    spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], "bit int, weights array<double>").write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str, bits: int = 256) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("bit").collect()  # a model matrix, of the model's size
    if len(rows) != bits or len({len(r["weights"]) for r in rows}) != 1:
        raise CorpusError(f"{path}: not a matrix of {bits} rows")
    return np.array([r["weights"] for r in rows])


def save_markov(table: DataFrame, path: str, half_life_s: float | None = None, elapsed_s: float = 0.0) -> None:
    """Transition rows, their weights decayed to the time of saving."""
    from parley.operators import markov

    (markov.decayed(table, half_life_s, elapsed_s) if half_life_s else table).write.mode("overwrite").parquet(path)


def load_markov(spark: SparkSession, path: str, max_order: int) -> DataFrame:
    """Transition rows of orders 1 .. max_order; totals follow from the weights."""
    return spark.read.parquet(path).where(F.col("ord").between(1, max_order))


def save_model(spark: SparkSession, model, path: str) -> None:
    """A successor model (tabular or of low rank) as a JSON file; a low-rank model's projection and features follow from the corpus and aren't written."""
    _put_text(spark, path, json.dumps(model.dump()))


def _saved(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))  # one model


def load_sr(spark: SparkSession, path: str):
    """A tabular successor model."""
    from parley.operators.successor import TabularSR

    return TabularSR.restore(_saved(spark, path))


def load_low_rank(spark: SparkSession, path: str, k: int, **options):
    """A low-rank successor model of rank k, made anew with `options` as at first; a saved model of another rank or length is an error."""
    from parley.operators.successor import LowRankSR

    saved = _saved(spark, path)
    if saved["normal"] != (options.get("projection") is not None):
        raise CorpusError(f"{path}: saved with {'a given' if saved['normal'] else 'the drawn'} projection")
    m = LowRankSR(k, gamma=saved["gamma"], eta=saved["eta"], warmup=saved["warmup"], **options)
    m.load(saved)
    return m


def save_warm_events(spark: SparkSession, events: list[int], path: str) -> None:
    """Ids of the events whose rows are worth keeping at hand."""
    _put_text(spark, path, json.dumps(sorted(events)))


def load_warm_events(spark: SparkSession, path: str, bridge: DataFrame, least: int = 1024) -> list[int]:
    """The saved ids of events that still exist and have `least` rows or more; without a file there are none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return []
    named = spark.createDataFrame([(e,) for e in _saved(spark, path)], "event_id int")
    return sorted(r["event_id"] for r in catalog.worth_keeping(bridge, least).join(F.broadcast(named), "event_id").collect())


def to_response(hits: DataFrame) -> DataFrame:
    """One JSON string of hits (rank, distance, id, event, text), in order of rank."""
    item = F.struct("rank", "distance", "id", "event", "text")
    return hits.agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("results"))).alias("response"))


def completion(hits: DataFrame, question: str, model: str = "parley") -> DataFrame:
    """An OpenAI-style completion whose content is the context lines of hits (rank, distance, id, event, text), with word counts as usage."""
    from parley.functions import text as T

    row = hits.agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "id", "event", "text"))).alias("hits"))
    content = T.context_lines(F.col("hits"))
    asked, told = T.word_count(F.lit(question)), T.word_count(content)
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    usage = F.struct(asked.alias("prompt_tokens"), told.alias("completion_tokens"), (asked + told).alias("total_tokens"))
    return row.select(F.to_json(F.struct(F.lit("chat.completion").alias("object"), F.lit(model).alias("model"), F.array(choice).alias("choices"), usage.alias("usage"))).alias("response"))
