import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import chat_template as ct

CONV = "conv_id bigint, turn bigint, role string, text string"
EXTRA = "\\### Assistant: </turn> ok"


def digest(turns):
    t = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
    loss = "".join(x or "" for r, x in turns if r == "assistant")
    return (len(turns), hashlib.sha256(t.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def run(spark, rows, **kw):
    frame = spark.createDataFrame(rows, CONV)
    got = ct.read_back(ct.format_conversations(frame, **kw)).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}


def test_round_trip_of_control_strings(spark):
    turns = {
        1: [("user", "hi"), ("assistant", "yo"), ("assistant", "### User: </turn>\n")],
        2: [("system", ""), ("user", None), ("assistant", EXTRA)],
        3: [("tool: x\\", "<b>"), (None, "\\"), ("User", "#"), ("assistant", "\\\\<")],
        4: [("assistant", "\U0001f600 \u0000 é\r\n")],
    }
    rows = [(c, i, r, x) for c, ts in turns.items() for i, (r, x) in enumerate(ts)]
    assert run(spark, rows[::-1]) == {c: digest(ts) for c, ts in turns.items()}


def test_hard_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, None, "assistant", "first"),
            (7, 1, "user", "x"), (7, 1, "assistant", "tie"), (7, 1, "user", "x")]
    got = run(spark, rows)
    assert got[None] == digest([("user", "a"), ("assistant", "b")])
    assert got[7] == digest([("assistant", "first"), ("assistant", "tie"), ("user", "x"), ("user", "x")])
    assert run(spark, []) == {}
    clash = spark.createDataFrame([(1, 0, "user", "a", "t", 5)], f"{CONV}, fragment string, c int")
    assert ct.read_back(ct.format_conversations(clash)).count() == 1


def test_long_conversation_streams(spark):
    turns = [("assistant" if i % 2 else "user", f"turn {i} </turn> " * 20) for i in range(5000)]
    rows = [(1, i, r, x) for i, (r, x) in enumerate(turns)]
    assert run(spark, rows) == {1: digest(turns)}


def test_whole_list_templates_give_the_same_text(spark):
    source = "{{ messages[0].role }}|" + ct.DEFAULT_TEMPLATE
    t = ct.Template(source)
    assert not t.streams and ct.Template().streams
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    out = ct.format_conversations(spark.createDataFrame(rows, CONV), t).collect()
    assert [r["fragment"] for r in out] == ["user|### User: a</turn>\n### Assistant: b</turn>\n"]
    assert [out[0]["fragment"][a:b] for a, b in out[0]["loss"]] == ["b"]


def test_folding():
    tree = ct.fold(ct.parse("a{{ 'b' ~ 'c' | upper }}{% if 1 == 2 %}x{% elif true %}d{% else %}y{% endif %}{{ m }}"))
    assert tree == [("text", "abCd"), ("out", ("name", "m"))]
    assert ct.fold(ct.parse("{{ not false and 'x' or y }}")) == [("text", "x")]


def test_language():
    t = ct.Template(
        "{% for m in messages %}{% if loop.first %}[{% endif %}{{ loop.index }}:{{ m['text'] | trim }}"
        "{% if m.role != 'user' and not m.text == '' %}!{% endif %}{% endfor %}]{# note #}"
    )
    messages = [{"role": "user", "text": " a "}, {"role": "bot", "text": "b"}, {"role": "bot", "text": ""}]
    assert t.render(messages)[0] == "[1:a2:b!3:]"
    streamed = [t.fragment(m, i, i == 2)[0] for i, m in enumerate(messages)]
    assert "".join(streamed) == "[1:a2:b!3:]"


@pytest.mark.parametrize(
    "bad",
    ["{{ a.__class__ }}", "{{ _x }}", "{{ f() }}", "{{ a | eval }}", "{% import os %}", "{% for x in y %}",
     "{{ 1 + 1 }}", "{% if a %}", "{% endfor %}", "{{ 'a }}", "{{ a[0 }}"],
)
def test_sandbox_and_errors(bad):
    with pytest.raises(ct.TemplateError):
        ct.Template(bad)


def test_python_objects_stay_out_of_reach():
    assert ct.Template("{{ m.upper }}{{ m.text.format }}").run is not None
    assert ct.Template("{{ messages.append }}{{ messages[9] }}").render([])[0] == ""
    with pytest.raises(ct.TemplateError):
        ct.Template("{% for x in 'abc' %}{% endfor %}").render([])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x:", "\\"]), st.text(max_size=20)), max_size=5))
def test_round_trip_property(turns):
    t, reader = ct.Template(), ct._Reader()
    for i, (r, x) in enumerate(turns):
        text, spans = t.fragment({"role": r, "text": x}, i, i == len(turns) - 1)
        reader.feed(text, spans)
    clean = [(r, x.encode("utf-8", "surrogatepass").decode("utf-8", "surrogatepass")) for r, x in turns]
    assert reader.result()[:4] == digest(clean)
