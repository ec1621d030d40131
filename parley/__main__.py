"""Command line: build an index, query it, train a Markov model on transcripts.

    python -m parley index corpus.jsonl folder [--bits 256]
    python -m parley query folder "a text" [-k 5] [--json]
    python -m parley train transcripts.jsonl folder [--max-order 3] [--half-life SECONDS]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("parley")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="build an index folder from JSON lines of id, text, event")
    index.add_argument("corpus")
    index.add_argument("folder")
    index.add_argument("--bits", type=int, default=256)
    query = sub.add_parser("query", help="the best entries for a text, which is read from standard input if it isn't given")
    query.add_argument("folder")
    query.add_argument("text", nargs="?")
    query.add_argument("-k", type=int, default=5)
    query.add_argument("--json", action="store_true")
    train = sub.add_parser("train", help="train on JSON lines of transcripts")
    train.add_argument("transcripts")
    train.add_argument("folder")
    train.add_argument("--max-order", type=int, default=3)
    train.add_argument("--half-life", type=float)
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from parley.operators import catalog, markov
    from parley.session import local_session
    from parley.sources import index_io as io

    a = arguments(args)
    spark = spark or SparkSession.getActiveSession() or local_session()
    try:
        if a.command == "index":
            io.build_index(io.read_corpus(spark, a.corpus), a.folder, a.bits)
            print(f"{io.load_index(spark, a.folder)['manifest']['n_entries']} entries")
        elif a.command == "query":
            hits = io.query_index(spark, a.folder, a.text if a.text is not None else sys.stdin.read(), a.k)
            if a.json:
                print(io.to_response(hits).first()[0])
            else:
                for r in hits.orderBy("rank").collect():  # k rows
                    print(f"{r['rank']}\t{r['distance']}\t{r['event']}\t{r['id']}\t{r['text']}")
        else:
            turns = io.read_transcripts(spark, a.transcripts)
            events = catalog.event_dim(turns)
            table = markov.transitions(markov.known(turns, events), markov.MarkovOptions(a.max_order, half_life_s=a.half_life))
            io.save_markov(table, f"{a.folder}/transitions")
            events.write.mode("overwrite").parquet(f"{a.folder}/events")
            print(f"{spark.read.parquet(f'{a.folder}/transitions').count()} transitions")
    except io.CorpusError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
