import pytest

from rubrica.llm.template import Template, TemplateError, fold, parse

TURNS = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]


def test_loops_conditions_and_filters():
    source = (
        "{% set mark = '#' %}{% for m in messages %}{% if loop.first %}^{% endif %}"
        "{{ loop.index ~ mark ~ m.role | upper }}:{% if m.role == 'user' and not m.none %}{{ m.text }}"
        "{% elif m.role != 'x' %}{% generation %}{{ m.text | trim }}!{% endgeneration %}{% else %}?{% endif %}"
        "{% if loop.last %}${% endif %}{% endfor %}"
    )
    text, spans = Template(source).text(TURNS)
    assert text == "^1#USER:hi2#ASSISTANT:yo!$"
    assert "".join(text[a:b] for a, b in spans) == "yo!"


def test_constants_are_folded():
    upper = {"upper": str.upper}
    assert fold(parse("a{{ 'b' | upper ~ 1 }}{% if true or x %}c{% else %}d{% endif %}{% if false %}e{% endif %}"), upper) == [("text", "aB1c")]
    assert fold(parse("{% if 1 == 2 %}a{% elif x %}b{% elif true %}c{% else %}d{% endif %}"), {}) == [
        ("if", [(("name", "x"), [("text", "b")])], [("text", "c")])
    ]


def test_sandbox():
    assert Template("{{ x.__class__ }}{{ missing.a.b }}|{{ none }}").text([], x="abc")[0] == "|"
    for bad in ("{{ f(1) }}", "{% import os %}", "{{ a b }}", "{% if x %}", "{% for x y %}{% endfor %}", "{{ x | nothing }}", "{{ 'a }}", "{% set 1 = 2 %}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_turn_by_turn_equals_the_whole():
    template = Template("<{% for m in messages %}{{ m.text }};{% endfor %}>")
    pieces = ["".join(t for t, _ in p) for p in template.pieces(iter(TURNS))]
    assert pieces == ["<hi;", "yo;>"] and "".join(pieces) == template.text(TURNS)[0]
    assert list(template.pieces([])) == []
    with pytest.raises(TemplateError):
        next(Template("{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}").pieces(TURNS))
