import json

from parley import __main__ as cli
from parley.streaming import requests
from parley.streaming import session as live


def test_routes(spark):
    chat = lambda user, *m: json.dumps({"user": user, "messages": [{"role": r, "content": c} for r, c in m]})
    rows = [
        ("GET", "/health", None, (None, "health", 10, None, 200)), ("GET", "/stats?x=1", "", (None, "stats", 10, None, 200)), ("POST", "/health", None, (None, None, None, None, 404)),
        ("POST", "/query", '{"query": "a text", "top_k": 3}', (None, "query", 3, "a text", 200)), ("POST", "/query", '{"query": "  "}', (None, None, None, None, 400)),
        ("POST", "/query", "no json", (None, None, None, None, 400)), ("GET", "/query", None, (None, None, None, None, 404)), ("POST", "/query", '{"query": "x", "top_k": -4}', (None, "query", 1, "x", 200)),
        ("POST", "/session/a/observe", '{"query": "so"}', ("a", "observe", 10, "so", 200)), ("post", "/session/a/finalize", '{"query": "so far", "top_k": 2}', ("a", "finalize", 2, "so far", 200)),
        ("POST", "/session/a/warm", None, ("a", "warm", 10, None, 200)), ("POST", "/session/a/reset", "{}", ("a", "reset", 10, None, 200)), ("POST", "/session/a/dance", "{}", (None, None, None, None, 404)),
        ("POST", "/session//warm", "{}", (None, None, None, None, 400)), ("POST", "/session/a/observe", "{}", (None, None, None, None, 400)),
        ("POST", "/v1/chat/completions", chat("u", ("user", "first"), ("assistant", "no"), ("user", "last"), ("assistant", "end")), ("u", "finalize", 5, "last", 200)),
        ("POST", "/v1/chat/completions", chat(None, ("user", "q")), (None, "query", 5, "q", 200)), ("POST", "/v1/chat/completions", chat("u", ("system", "x")), (None, None, None, None, 400)),
    ]
    df = spark.createDataFrame([(i, m, p, b, "extra", "kept") for i, (m, p, b, _) in enumerate(rows)], "seq bigint, method string, path string, body string, text string, other string").selectExpr("*", "timestamp_seconds(seq) AS ts")
    got = {r["seq"]: (r["session"], r["action"], r["k"], r["text"], r["status"]) for r in requests.routed(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(rows)}
    log = requests.session_log(requests.routed(df))
    assert {(r["session"], r["action"]) for r in log.collect()} == {("a", "observe"), ("a", "finalize"), ("a", "warm"), ("a", "reset"), ("u", "finalize")}
    corpus = log.selectExpr("seq AS doc_idx", "s0", "s1", "s2", "s3", "0 AS event_id")
    assert live.replay(log, corpus).where("served_by IN ('full_scan', 'speculative', 'delta_cache')").count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": f"d{i}", "text": t, "event": e}) + "\n" for i, (t, e) in enumerate([("price of the plan", "pricing"), ("reset my password", "account"), ("cancel the plan today", "pricing")])))
    (tmp_path / "t.jsonl").write_text('{"events": ["a", "b", "a", "b"]}\n{"session": "s", "event": "b"}\n{"session": "s", "event": "a"}\n')
    assert cli.main(["index", str(tmp_path / "c.jsonl"), str(tmp_path / "i")], spark) == 0
    assert cli.main(["query", str(tmp_path / "i"), "reset my password", "-k", "1"], spark) == 0
    assert cli.main(["query", str(tmp_path / "i"), "cancel the plan today", "-k", "2", "--json"], spark) == 0
    assert cli.main(["train", str(tmp_path / "t.jsonl"), str(tmp_path / "m"), "--max-order", "1"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "3 entries" and out[1].startswith("1\t0\taccount\td1\t") and json.loads(out[2])["results"][0]["id"] == "d2" and out[3] == "2 transitions"
    assert cli.main(["query", str(tmp_path / "i"), " "], spark) == 1 and "empty" in capsys.readouterr().err


def test_transcribers(spark):
    rows = [("s", 0, "interim", "so"), ("s", 1, "Final", "so far"), ("s", 2, "bot_started_speaking", None), ("s", 3, "noise", "x"), ("s", 4, "final", "  "), ("s", 5, "end", None)]
    df = spark.createDataFrame(rows, "session string, seq bigint, kind string, text string").selectExpr("*", "timestamp_seconds(seq) AS ts")
    got = requests.of_transcriber(df)
    assert [(r["seq"], r["action"]) for r in got.orderBy("seq").collect()] == [(0, "observe"), (1, "finalize"), (2, "warm"), (5, "reset")]
    assert requests.session_log(got).count() == 4
