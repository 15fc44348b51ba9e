import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import chat

AWKWARD = ["", None, "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "<t>", "[", "<", "\\", "[/INST", "INST]", "\n", "a\nb", "s>", "é𝛼 <s><t></s>", "[\\INST]", "[INST]" * 3]


def expected(rows):
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by_id.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.read_conversations(chat.format_conversations(df))).collect()}
    assert got == expected(rows)


def test_awkward_texts(spark):
    roles = ["user", "assistant", "assistant", "system", None, "a\nb\\n<s>", "[/INST]", ""]
    rows = [(k % 5, k // 2, roles[(k * 3) % len(roles)], t) for k, t in enumerate(AWKWARD * 4)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (7, 1, "user", "same"), (7, 1, "user", "same"), (8, 1, None, None), (9, 0, "assistant", "word " * 50_000)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from(["user", "assistant", "<s>"]), st.text(alphabet="<[\\/st>INST]\na", max_size=12)), max_size=12))
def test_any_text_comes_back(spark, turns):
    check(spark, [(c, k, r, t) for k, (c, r, t) in enumerate(turns)])


def test_neighbours_of_one_role_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "[INST]user\na<t>b[/INST]<s>assistant\nc<t>d</s>[INST]user\ne[/INST]"


def test_no_python_in_the_plan(spark):
    plan = chat.op7_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
