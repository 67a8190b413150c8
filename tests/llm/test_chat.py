import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import chat

SHAPE = "conv_id long, turn long, role string, text string, loss int, formatted string"
T = chat.Template()
#: Texts out of marks, backslashes and other characters.
PIECES = st.lists(st.sampled_from([*T.controls, "\\", "<", "[", "/", "s>", "INST]", "é", "\U0001f600", "a b", "\n", "﻿", ""]), max_size=6).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "a[AS]b", "[/ROLE]", "x\ny", None])


def plain(rows):
    """conv_id, n_turns and digests straight from the rows."""
    groups = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        groups.setdefault(conv if conv is not None else ("alone", k), []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns = [t[2:] for t in sorted(turns)]
        learned = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv if not isinstance(conv, tuple) else None, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learned), sha(learned)))
    return sorted(out, key=repr)


def formatted(spark, rows):
    return chat.format_conversations(spark.createDataFrame([(*r, 0, "clash") for r in rows], SHAPE))


def read_back(spark, rows):
    return sorted((tuple(r)[:5] for r in chat.digest(formatted(spark, rows)).collect()), key=repr)


def test_marks(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 0, "system", "s"), (1, 3, "assistant", "</s>"), (1, 4, "tool", "t"), (1, 5, "assistant", "é[INST]")]
    r = formatted(spark, rows).first()
    assert r.formatted == r"<s>[SYS]s[/SYS][INST]a[NEXT]b[/INST][OUT]<\/s></s>[ROLE]tool[AS]t[/ROLE][OUT]é[\INST]</s>"
    assert [r.formatted[x.start : x.end] for x in r.loss] == [r"<\/s>", r"é[\INST]"]
    assert [r.formatted.encode()[x.first_byte : x.end_byte].decode() for x in r.loss] == [r"<\/s>", r"é[\INST]"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([0, 1, 2, 3, None]), ROLES, st.one_of(st.none(), PIECES)), max_size=60))
def test_round_trip(spark, rows):
    assert read_back(spark, rows) == plain(rows)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_escaped_texts_hold_no_mark(text):
    rests = T._rests
    escaped = re.sub(rf"([<\[])(\\*)({rests})", r"\1\2\\\3", text)
    assert not any(c in escaped for c in T.controls)
    assert re.sub(rf"([<\[])\\(\\*)({rests})", r"\1\2\3", escaped) == text


def test_query_reads_back_all_turns(spark):
    from strandloom.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op12_chat_format(spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(rows)


def test_empty_table_long_texts_and_many_turns(spark):
    assert formatted(spark, []).count() == 0
    rows = [(1, 0, "assistant", "[OUT]é" * 300_000), (1, 1, "assistant", ""), *((2, k // 2, "user" if k % 3 else "assistant", f"t{k}") for k in range(3000))]
    assert read_back(spark, rows) == plain(rows)


def test_no_python_and_one_shuffle(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat.digest(chat.format_conversations(turns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan
