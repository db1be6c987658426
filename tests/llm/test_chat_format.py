"""Event folding, rendering and reading back."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from certlens.llm import chat_format as chat

TEXT = st.lists(st.sampled_from([*chat.CONTROL, "\\", " ", "a", "\n", "<", "[", "/", "s>", "INST]", "é語"]), max_size=12).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT), TEXT), max_size=6)


@given(TURNS)
@settings(max_examples=500, deadline=None)
def test_round_trip(turns):
    formatted, mask = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_fold():
    log = [("start", 1, "user", "hi"), ("start", 2, "assistant", ""), ("delta", 2, None, "Hel"), ("delta", 2, None, "lo"), ("start", 3, "user", "more"),
           ("start", 4, "assistant", "x"), ("regenerate", 2, None, None), ("delta", 2, None, "Bye"), ("edit", 1, None, "hey"), ("delta", 9, None, "late"), ("delete", 7, None, None)]
    assert chat.fold(iter(log)) == [("user", "hey"), ("assistant", "Bye"), ("assistant", "late")]
    assert chat.fold(iter([("start", 1, None, None), ("delete", 1, None, None)])) == []
    assert chat.fold(iter([("start", 1, "user", "a"), ("start", 1, "user", "b")])) == [("user", "b")]


def reference(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = set()
    for conv, turns in out.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        result.add((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render(turns)[0])))
    return result


def test_rows_to_digests(spark):
    rows = [(1, 2, "assistant", "b" * 2500), (1, 1, "user", "</s>[INST]"), (1, 1, "user", "</s>[INST]"), (2, 0, "user", None), (2, 1, None, ""), (None, 5, "tool", "t"),
            (3, None, "system", "s"), (3, 0, "assistant", "x" * 1000), (3, 0, "assistant", "y"), (4, 1, "assistant", "é\\[/INST]" * 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.digests(chat.format_conversations(chat.events_of_rows(df)))
    assert set(map(tuple, got.collect())) == reference(rows)


def test_event_log(spark):
    log = [(1, 3, "delta", 2, None, "lo"), (1, 1, "start", 1, "user", "q"), (1, 2, "start", 2, "assistant", "hel"), (1, 4, "edit", 1, None, "question"), (2, 1, "delta", 1, None, "only")]
    df = spark.createDataFrame(log, chat.EVENTS)
    got = {r.conv_id: r for r in chat.format_conversations(df.selectExpr("'x' AS formatted", "*")).collect()}
    assert chat.read_back(got[1].formatted) == [("user", "question"), ("assistant", "hello")]
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_mask] == ["hello"]
    assert chat.read_back(got[2].formatted) == [("assistant", "only")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert set(map(tuple, chat.digests(chat.format_conversations(chat.events_of_rows(df))).collect())) == reference(rows)
