"""Requests to a retrieval service as rows: what each asks for, and the log that sessions are run on.

The rows may come from a file, a queue or a gateway in front of them; the same
expressions route a batch and a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import signature as S
from parley.operators import embed

TOP_K, CHAT_TOP_K = 10, 5
_BODY = "query string, top_k int, user string, messages array<struct<role:string,content:string>>"


def latest_of_user(messages: Column) -> Column:
    """The content of the last message whose role is user; null if there is none."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])), -1)


def routed(requests: DataFrame) -> DataFrame:
    """Requests (seq, ts, method, path, body, ...) with session, action, k, text and status.

    `POST /session/<name>/<observe|finalize|warm|reset>` is an action of that session.
    `POST /v1/chat/completions` takes the last message of the user and finalizes the
    session named as `user`, or is a `query` without one; `POST /query` is a query.
    `GET /health` and `GET /stats` are actions of no session. status is 404 for any
    other path, and 400 for a body that isn't JSON, a blank text where one is needed,
    or an empty name; action, k and text are then null. k is at least 1.
    """
    path, post = F.split_part("path", F.lit("?"), F.lit(1)), F.upper("method") == "POST"
    named = F.regexp_extract(path, r"^/session/([^/]*)/(observe|finalize|warm|reset)$", 2)
    chat, query = path == "/v1/chat/completions", path == "/query"
    body = F.from_json(F.when(F.trim("body") == "", F.lit("{}")).otherwise(F.coalesce("body", F.lit("{}"))), _BODY + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    r = requests.withColumn("_body", body)
    action = (
        F.when(post & (named != ""), named).when(post & chat, F.when(F.coalesce("_body.user", F.lit("")) != "", "finalize").otherwise("query")).when(post & query, "query")
        .when((F.upper("method") == "GET") & path.isin("/health", "/stats"), F.substring(path, 2, 100))
    )
    session = F.when(named != "", F.regexp_extract(path, r"^/session/([^/]*)/", 1)).when(chat & (F.coalesce("_body.user", F.lit("")) != ""), F.col("_body.user"))
    text = F.when(chat, latest_of_user(F.col("_body.messages"))).otherwise(F.col("_body.query"))
    r = r.select("*", action.alias("_action"), session.alias("_session"), text.alias("_text"), F.greatest(F.coalesce("_body.top_k", F.when(chat, CHAT_TOP_K).otherwise(TOP_K)), F.lit(1)).alias("_k"))
    needs = F.col("_action").isin("observe", "finalize", "query")
    wrong = F.col("_body._bad").isNotNull() | (needs & (F.coalesce(F.trim("_text"), F.lit("")) == "")) | (F.coalesce("_session", F.lit("x")) == "")
    status = F.when(F.col("_action").isNull(), 404).when(wrong, 400).otherwise(200)
    fine = lambda c: F.when(status == 200, F.col(c))
    kept = [c for c in requests.columns if c not in ("session", "action", "k", "text", "status")]
    return r.select(*kept, fine("_session").alias("session"), fine("_action").alias("action"), fine("_k").alias("k"), F.when((status == 200) & needs, F.col("_text")).alias("text"), status.alias("status"))


def of_transcriber(events: DataFrame) -> DataFrame:
    """Actions (session, seq, ts, action, k, text, status) of a voice framework's events (session, seq, ts, kind, text).

    Interim transcripts are partials, final ones finalize, and while the bot begins to
    speak the next scope is warmed; other kinds of events are left out, as are blank
    transcripts.
    """
    kind = F.lower("kind")
    action = F.when(kind.isin("interim", "partial"), "observe").when(kind == "final", "finalize").when(kind.isin("bot_started_speaking", "bot_speaking"), "warm").when(kind.isin("end", "reset"), "reset")
    out = events.select("session", "seq", "ts", action.alias("action"), F.lit(TOP_K).alias("k"), "text", F.lit(200).alias("status")).where("action IS NOT NULL")
    return out.where(~F.col("action").isin("observe", "finalize") | (F.trim(F.coalesce("text", F.lit(""))) != ""))


def session_log(actions: DataFrame, bits: int = 256, **options) -> DataFrame:
    """The log (session, seq, ts, action, k, s0, ...) of routed requests that are actions of a session."""
    on = actions.where((F.col("status") == 200) & F.col("session").isNotNull()).withColumn("_signature", embed.signature_of("text", bits, **options))
    return on.select("session", "seq", "ts", "action", "k", *[F.col(f"_signature.{w}").alias(w) for w in S.word_names(bits)])
