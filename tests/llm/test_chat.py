import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from docgrid.llm import chat

TURNS = [
    (1, 0, "user", "Hi <|end|> there"), (1, 1, "assistant", "a\\b <|> |> <| \\"), (1, 2, "assistant", "<"), (2, 0, "user", None),
    (2, 1, None, "role"), (3, None, "assistant", "one"), (3, 5, "assistant", "two"), (3, 5, "assistant", "two"), (None, 0, "user<|text|>", "no id"),
    (4, 0, "assistant", ""), (5, 0, "assistant", "x" * 200_000),
]


@given(st.text(alphabet="<|>\\ab\n"))
def test_escape_round_trip(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and "<|" not in e and "|>" not in e


def test_language():
    render = lambda t, **v: "".join(p for p, _ in chat.compile_template(t)(v))
    assert render("{% set a = 'x' ~ 1 ~ 2 %}{{ a }}{# no #}{{ 'b' | upper }}") == "x12B"
    t = "{% for m in ms %}{% if loop.first %}[{% elif m.k in 'bc' and not loop.last %}-{% else %}+{% endif %}{{ m['k'] }}{{ loop.index }}{% endfor %}"
    assert render(t, ms=[{"k": "a"}, {"k": "b"}, {"k": "c"}]) == "[a1-b2+c3"
    assert render("{{ m.__class__ }}{{ m.missing | default('d') }}", m={"a": 1}) == "d"
    assert render("{{ x.upper }}", x="s") == ""
    for bad in ("{{ open('f') }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | eval }}", "{% endfor %}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_folding():
    assert chat.fold_body(chat.parse("a{% if 1 == 1 %}b{{ 'c' | upper }}{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}")) == [("text", "abC")]
    assert chat.fold(("and", ("const", False), ("name", "x"))) == ("const", False)
    assert chat.fold(("and", ("const", True), ("name", "x"))) == ("name", "x")


def test_conversations(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, part string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert len(got) == 6
    for conv in got:
        rows = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in TURNS if c == conv)
        said = [x for _, r, x in rows if r == "assistant"]
        r = got[conv]
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest()
        assert r["loss_chars"] == sum(map(len, said)) and r["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_a_long_conversation_has_parts(spark):
    df = spark.range(3000).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('ab ', 40) text")
    parts = chat.format_conversations(df)
    assert parts.count() > 3
    r = chat.read_back(parts).first()
    assert r["n_turns"] == 3000 and r["loss_chars"] == 1500 * 120
