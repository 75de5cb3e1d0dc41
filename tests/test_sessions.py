"""The session stream against a plain loop: restarts, repeated turns and repeated batches lose and double nothing."""

from __future__ import annotations

import json

from memengine.streaming import sessions


def turn(session, n, role, text):
    return {"type": "message", "session": session, "turn_id": f"{n:04d}", "role": role, "text": text, "ts": f"2024-01-01T{n // 60:02d}:{n % 60:02d}:00Z"}


def said(n):
    return f"a question of some length, number {n}", f"a reply with more than thirty characters, number {n}"


def plain(rows):
    out, seen, waiting, earlier = [], set(), {}, {}
    for r in rows:
        s = r.get("session")
        if r.get("type") != "message" or r.get("role") not in ("user", "assistant") or (s, r["turn_id"]) in seen:
            continue
        seen.add((s, r["turn_id"]))
        if r["role"] == "user":
            waiting[s] = r["text"]
        elif s in waiting:
            human = waiting.pop(s)
            short = len(human) < 15 and len(r["text"]) < 30
            if not short and "HEARTBEAT" not in human and "NO_REPLY" not in r["text"]:
                own = earlier.setdefault(s, [])
                out.append((s, r["turn_id"], human, r["text"], len(own[-4:]), "\n".join(own[-4:])))
                own.append(f"Human: {human}\nAgent: {r['text']}")
    return sorted(out)


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def test_restarts_and_repeats(spark, tmp_path):
    logs, sink, progress = tmp_path / "logs", f"file://{tmp_path}/sink", f"file://{tmp_path}/progress"
    logs.mkdir()
    first = [turn("a", 2 * i + k, ("user", "assistant")[k], said(i)[k]) for i in range(7) for k in (0, 1)] + [turn("b", 1, "user", "hi"), turn("b", 2, "assistant", "yo")]
    second = [turn("a", 12, "user", said(6)[0]), turn("a", 13, "assistant", said(6)[1]), turn("a", 14, "user", "HEARTBEAT, are you there?"), turn("a", 15, "assistant", said(9)[1]), turn("b", 3, "user", said(3)[0])]
    third = [turn("b", 4, "assistant", said(3)[1]), turn("b", 5, "assistant", "nobody asked for this reply at all"), turn("b", 6, "user", said(5)[0]), turn("b", 7, "user", said(6)[0]), turn("b", 8, "assistant", said(6)[1]), turn("a", 16, "user", said(4)[0]), turn("a", 17, "assistant", "NO_REPLY")]
    done = []
    for i, rows in enumerate((first, second, third)):
        write(logs / f"{i}.jsonl", [*rows, "not json", {"type": "other", "session": "a"}])
        sessions.follow(spark, f"file://{logs}", sink, progress, once=True).awaitTermination()  # each time a new query from the same checkpoint
        done += rows
        got = sorted((r["session"], r["turn_id"], r["human"], r["reply"], r["n_before"], r["context"]) for r in sessions.stored(spark, sink).collect())
        assert got == plain(done)
    sessions.follow(spark, f"file://{logs}", sink, progress, once=True).awaitTermination()
    assert sessions.stored(spark, sink).count() == len(plain(done))
    all_ = sessions.stored(spark, sink)
    now = {r["session"]: r for r in sessions.contexts(all_).collect()}
    kept = [x for x in plain(done) if x[0] == "a"]
    assert now["a"]["exchanges"] == 4 and now["a"]["context"] == "\n".join(f"Human: {h}\nAgent: {t}" for _, _, h, t, _, _ in kept[-4:]) and now["b"]["exchanges"] == 2
    last = all_.agg({"batch": "max"}).first()[0]
    assert {r["session"] for r in sessions.contexts(all_, since=last - 1).collect()} == {"b"}


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    sink = f"file://{tmp_path}/sink"
    write_ = sessions.into(sink)
    rows = spark.createDataFrame([("a", "1", "h", "r", 0, "")], sessions.EXCHANGE)
    for number in (0, 0, 1, 1, 0):
        write_(rows, number)
    assert sessions.stored(spark, sink).count() == 2
