import json

import duckdb
import pytest

from tokenloom.llm import chat_format as C
from tokenloom.llm import html_extraction as H

PROSE = "This paragraph has quite a few words so that it looks like the body of an article, " * 3


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p></article><footer>(c) us</footer></body>", f"Title\n{PROSE.strip()}"),
        ("<article><p>A &lt;b&gt; &amp;amp; caf&eacute;&nbsp;x  \n y<br>z</p></article>", "A <b> &amp; café x y z"),
        ("<article><p>1 < 2 & 3 > 2</p><script>if (a < b) { x('</p>') }</script><style>p{}</style></article>", "1 < 2 & 3 > 2"),
        (f"<article><p>{PROSE}<p>Second one.<p>Be.</article>", f"{PROSE.strip()}\nSecond one.\nBe."),
        (f"<article><p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div></article>", PROSE.strip()),
        (f"<div class='cookie-notice'>We use cookies.</div><header>Name</header><main><p>{PROSE}</p><form><label>Mail</label><input></form></main><aside>More</aside>", PROSE.strip()),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<!-- <p>no</p> --><article><!-- x --><p>yes</p></article>", "yes"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_tree_fits_its_table():
    x, y = H._labelled()
    assert (H.tree().wanted(x) == (y > 0)).mean() > 0.98


def test_tree_uses_words_links_and_neighbours():
    used = {H.FEATURES[f] for f in H.tree().feature if f >= 0}
    assert {"words", "links", "words before", "links after"} <= used


LEAD = "The harbour was built in three stages, and each of them took longer than the town had hoped for."
BODY = "Masons came from the valley in spring; by autumn most had gone home again, and the wall stood half finished through two winters of storms."
#: Pages of shapes that the labelled table doesn't have, with their main text.
HELD_OUT = [
    (f"<html><head><title>t</title></head><body><div class='site-header'><a href=/>Home</a> <a href=/n>News</a></div><div class='post-header'><h1>The wall</h1></div><div class='post-body'><p>{LEAD}</p><p>{BODY}</p><p>It held.</p></div><div class='post-comments'><p>{BODY}</p></div><div id=footer>All rights reserved</div></body></html>", f"The wall\n{LEAD}\n{BODY}\nIt held."),
    (f"<body><ul class=mainMenu><li><a href=a>One</a><li><a href=b>Two</a></ul><h1>The wall</h1><p>{LEAD}</p><p>{BODY}</p><p>{BODY}</p><table class=relatedLinks><tr><td><a href=c>Another wall</a></td></tr></table></body>", f"The wall\n{LEAD}\n{BODY}\n{BODY}"),
    (f"<body><main role=main><p>{LEAD}</p><div aria-label='Main navigation'><p>{LEAD}</p></div><div class='AdSlot'>{BODY}</div><dl><dt>Wall</dt><dd>{LEAD}</dd></dl></main></body>", f"{LEAD}\nWall\n{LEAD}"),
    (f"<body><article class=story><header><h1>Wall</h1><p>By a mason</p></header><p>{BODY}</p><figure><img src=x><figcaption>The wall in 1911</figcaption></figure><pre>a  b\n c</pre></article><div class=consent-banner>{LEAD}</div></body>", f"Wall\nBy a mason\n{BODY}\nThe wall in 1911\na b c"),
    (f"<body><a href=1>one</a><br><a href=2>two</a><hr><h2>Wall</h2>{LEAD}<p>{BODY}<hr><a href=3>three</a></body>", f"Wall\n{LEAD}\n{BODY}"),
]


@pytest.mark.parametrize("page, text", HELD_OUT)
def test_held_out_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><p>{LEAD}</p><script>if(a<b) s.replace(/"/g,1);</script><p>{BODY}</p><p>a "quoted" end</p></article>', f'{LEAD}\n{BODY}\na "quoted" end'),
        (f'<article><p>{LEAD}</p><div class="section" id="discussion"><p>{BODY}</p></div><section id="legal-history"><p>{LEAD}</p></section><div class="header-image-caption">The wall</div></article>', f"{LEAD}\n{BODY}\n{LEAD}\nThe wall"),
        (f"<article><button>Go <p>{LEAD}</p><button>x</button><p>{BODY}</p></article>", f"Go\n{LEAD}\n{BODY}"),
        (f"<article><p>{LEAD}</p><script>var x = 1 <p>{BODY}</p></article>", f"{LEAD}\n{BODY}"),
        (f"<article><p class=x\">{LEAD} <a href='y'>y</a></p><svg><text>no</text></svg></article>", f"{LEAD} y"),
        ("<div>" * 50_000 + f"<p>{BODY}</p>" + "</div>" * 60_000 + "</section>" * 50_000, BODY),
        (f"<article><p>{LEAD}</p>" + "<svg>" * 20_000 + f"<p>{BODY}</p></article>", f"{LEAD}\n{BODY}"),
    ],
    ids=["script", "names", "button", "open script", "quote", "deep", "open svg"],
)
def test_markup_that_misleads(page, text):
    assert H.main_text(page) == text


def test_neighbours_are_features():
    b = H.page_blocks("<p>one two</p><p><a href=x>three</a> four</p><p>five</p>")
    f = H.features(b)
    assert f[1, :6].tolist() == [2, 0.5, 2, 0, 1, 0]


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>x y</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>x y</p></article>"), (3, "v", "<article><p>" + "long " * 100_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.extract(df).collect()))
    assert out == sorted([(1, "u", "x y", 3), (1, "u", "x y", 3), (2, "", "", 0), (0, "u", "", 0), (3, "v", ("long " * 100_000).strip(), 499_999)])
    assert H.extract(df.limit(0)).count() == 0


TOOLS = '<tools>[{"name":"f","parameters":{"type":"object","properties":{"a":{"type":"integer"}},"required":["a"],"additionalProperties":false}}]</tools>'
MESSAGES = "conv_id long, turn long, role string, text string"


def call(key, name, **arguments):
    return "<tool_call>" + json.dumps({"name": name, "id": key, "arguments": arguments}) + "</tool_call>"


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "system", TOOLS), (1, 1, "assistant", "é " + call("c1", "f", a=2)), (1, 2, "tool", '{"tool_call_id":"c2","content":"early"}'), (1, 3, "tool", '{"tool_call_id":"c1","content":{"z":1}}'),
        (1, 4, "assistant", call("c2", "f", a={"$ref": "c1"}) + call("c3", "f", a="x") + "<tool_call>no</tool_call>"), (1, 5, "assistant", call("x", "g", a={"$ref": "y"}) + call("y", "g", a={"$ref": "x"})),
        (1, 6, "tool", '{"tool_call_id":"nobody","content":"?"}'), (2, 0, "assistant", call("c1", "f", a=2)), (2, 1, "tool", '{"tool_call_id":"c1","content":"other conversation"}'),
    ]
    out = {(r.conv_id, r.turn): r for r in C.chat_format(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert out[1, 1].json == '{"content":"é ","role":"assistant","tool_calls":[{"arguments":{"a":2},"id":"c1","name":"f"}]}'
    assert (out[1, 1].n_calls, out[1, 1].n_linked, out[1, 1].n_invalid, out[1, 1].level) == (1, 1, 0, 0)
    assert (out[1, 4].n_calls, out[1, 4].n_linked, out[1, 4].n_invalid, out[1, 4].level) == (3, 1, 2, 1)
    # the early result moves behind its call
    assert (out[1, 2].order_turn, out[1, 2].level, out[1, 2].n_linked) == (4, 2, 1)
    assert json.loads(out[1, 3].json) == {"content": '{"z":1}', "name": "f", "role": "tool", "tool_call_id": "c1"}
    assert out[1, 5].level is None and out[1, 6].n_linked == 0
    assert out[2, 0].n_invalid == 0 and out[2, 1].n_linked == 1


def test_chain_of_needs(spark):
    rows = [(1, 10 - k, "assistant", call(f"k{k}", "f", **({"a": {"$ref": f"k{k - 1}"}} if k else {}))) for k in range(6)]
    out = {r.turn: (r.level, r.order_turn) for r in C.chat_format(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert out == {10 - k: (k, 10) for k in range(6)}


def test_messages_without_calls_and_edges(spark):
    rows = [(1, 0, "user", 'a "quoted"\n\ttext \\ é '), (1, 0, "user", 'a "quoted"\n\ttext \\ é '), (1, 1, None, None), (None, None, "tool", "x"), (2, 0, "assistant", ""), (3, 0, "tool", "[]"), (4, 1, "system", "<tools>no</tools>"), (5, 0, "user", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], MESSAGES + ", json string")
    out = C.chat_format(df).collect()
    assert len(out) == 7 and all(r.n_calls == 0 for r in out)
    for r in out:
        assert json.loads(r.json)["role"] == r.role
    assert C.chat_format(df.limit(0)).count() == 0


def test_repeated_identifiers_and_results(spark):
    rows = [(1, 1, "assistant", call("c", "f", a=1)), (1, 2, "assistant", call("c", "g")), (1, 3, "tool", '{"tool_call_id":"c","content":"1"}'), (1, 4, "tool", '{"tool_call_id":"c","content":"2"}')]
    out = {r.turn: r for r in C.chat_format(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert [out[t].n_linked for t in (1, 2, 3, 4)] == [1, 0, 1, 1] and '"name":"f"' in out[4].json


@pytest.mark.parametrize(
    "value, schema, ok",
    [
        (1, {"type": "integer"}, True), (True, {"type": "integer"}, False), (1.0, {"type": "integer"}, True), (1.5, {"type": "integer"}, False), ("a", {"enum": ["a", 1]}, True), ("b", {"enum": ["a"]}, False),
        ([1, "x"], {"type": "array", "items": {"type": "integer"}}, False), ({"a": 1}, {"required": ["b"]}, False), ({"a": 1}, {"additionalProperties": False}, False), (None, {"type": ["null", "string"]}, True),
        (5, {"maximum": 4}, False), ("ab", {"pattern": "^a"}, True), ({}, True, True), ({}, False, False), ([1], {"minItems": 2}, False), ("abc", {"maxLength": 2}, False), ({"x": {"$ref": "k"}}, {"properties": {"x": {"type": "integer"}}}, True),
    ],
)
def test_schemas(value, schema, ok):
    assert C.fits(value, schema) is ok


@pytest.mark.parametrize(
    "value, schema, ok",
    [
        (1, {"anyOf": [{"type": "string"}, {"type": "null"}]}, False), ("a", {"anyOf": [{"type": "string"}, {"type": "null"}]}, True),
        (1, {"oneOf": [{"type": "integer"}, {"minimum": 0}]}, False), (1, {"oneOf": [{"type": "integer"}, {"minimum": 2}]}, True),
        (1, {"allOf": [{"type": "integer"}, {"minimum": 2}]}, False), ("a", {"not": {"type": "string"}}, False),
        (1, {"exclusiveMinimum": 1}, False), (2, {"exclusiveMaximum": 2}, False), (1.5, {"exclusiveMinimum": 1, "exclusiveMaximum": 2}, True),
        (0.3, {"multipleOf": 0.1}, True), (7, {"multipleOf": 2}, False), ([1, 2, 1], {"uniqueItems": True}, False),
        ({"x_a": 1}, {"patternProperties": {"^x_": {"type": "string"}}}, False), ({"x_a": "b"}, {"patternProperties": {"^x_": {"type": "string"}}, "additionalProperties": False}, True),
        ({"a": {"a": 1}}, {"$defs": {"t": {"properties": {"a": {"$ref": "#/$defs/t"}}, "type": "object"}}, "$ref": "#/$defs/t"}, False),
        ({"a": {"a": {}}}, {"$defs": {"t": {"properties": {"a": {"$ref": "#/$defs/t"}}, "type": "object"}}, "$ref": "#/$defs/t"}, True),
        (1, {"$ref": "#"}, True), (1, {"$ref": "elsewhere.json"}, False), ({"a": {"$ref": "c1"}}, {"not": {"properties": {"a": {"type": "string"}}}}, True),
    ],
)
def test_schema_combinations(value, schema, ok):
    assert C.fits(value, schema) is ok


def test_sql_on_plain_conversations(spark):
    rows = [(1, 0, "user", 'q "x"\né\t'), (1, 1, "assistant", "a"), (2, 0, "system", None)]
    df = spark.createDataFrame(rows, MESSAGES)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert sorted(con.execute(C.ORACLE).fetchall(), key=repr) == sorted(map(tuple, C.chat_format(df).collect()), key=repr)


@pytest.mark.parametrize(
    "schema",
    [{"minLength": "3"}, {"pattern": "("}, {"pattern": 3}, {"enum": 3}, {"type": [{}]}, {"type": "strng"}, {"$ref": "#/x"}, {"allOf": 3}, {"anyOf": [3]}, {"not": 3, "allOf": [[]]}, {"maxLength": None}, 7, [], "x"],
)
def test_malformed_schemas_fit_nothing(schema):
    assert C.valid("abcdef", schema) is False


def test_malformed_keywords_for_objects_and_numbers():
    for schema in ({"properties": ["a"]}, {"required": 3}, {"properties": {"a": {"multipleOf": "2"}}}, {"patternProperties": {"(": True}}, {"properties": {"a": {"minimum": "0"}}}, {"minProperties": "1"}):
        assert C.valid({"a": 1}, schema) is False
    # a keyword counts only where it applies
    assert C.valid(1, {"minLength": "3"}) is True


def test_pattern_that_never_ends(monkeypatch):
    monkeypatch.setattr(C, "PATTERN_SECONDS", 0.2)
    assert C.valid("a" * 200 + "b", {"pattern": r"^(a|aa|(a+)+)+$"}) is False


def test_numbers_surrogates_and_nesting_are_no_crash(spark):
    deep = '{"a":' * 300_000 + "1" + "}" * 300_000
    texts = ['{"id":"c","name":"f","arguments":{"a":1e999}}', '{"id":"c","name":"f\\ud800","arguments":{}}', '{"id":"c","name":"f","arguments":' + deep + "}", '{"id":"c","name":"f","arguments":{"a":NaN}}', '{"id":"d","name":"f","arguments":{"a":12345678901234567890123}}']
    rows = [(1, 0, "system", '<tools>[{"name":"f","parameters":{"properties":{"a":{"pattern":"("}}}}, {"name":"\\udfff"}]</tools>')]
    rows += [(1, k + 1, "assistant", f"<tool_call>{t}</tool_call>") for k, t in enumerate(texts)] + [(1, 9, "tool", '{"tool_call_id":"d","content":"\\ud800"}'), (1, 10, "tool", '{"tool_call_id":"d","content":1e400}')]
    out = {r.turn: r for r in C.chat_format(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert len(out) == len(rows) and [out[k].n_invalid for k in range(1, 6)] == [1, 1, 1, 1, 0]
    assert [out[k].n_linked for k in (9, 10)] == [0, 0]


def test_both_ways_to_order_calls(spark):
    """A long chain, a cycle, an unknown need and null turns, in one pass and by joins."""
    rows = [(1, f"k{k}", 100 - k, [f"k{k - 1}"] if k else []) for k in range(12)] + [(2, "x", 1, ["y"]), (2, "y", 2, ["x"]), (2, "z", 3, ["nobody"]), (2, "w", None, []), (2, "v", None, ["w"]), (None, "n", 1, [])]
    df = spark.createDataFrame(rows, "conv_id long, id string, turn long, needs array<string>")
    one, other = (sorted(map(tuple, C.levels(df, small).collect()), key=repr) for small in (C.SMALL, 0))
    assert one == other and len(one) == 14 and (1, "k11", 11, 100) in one


def test_long_chain_in_one_pass(spark):
    rows = [(1, 2 * k, "assistant", call(f"k{k}", "f", **({"a": {"$ref": f"k{k - 1}"}} if k else {}))) for k in range(3000)]
    out = C.chat_format(spark.createDataFrame(rows, MESSAGES)).agg({"level": "max"}).first()[0]
    assert out == 2999


def test_sql_on_conversations_with_calls(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", "x" * (40 * t + c)) for c in range(4) for t in range(14)]
    df = spark.createDataFrame(rows, MESSAGES)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = sorted(con.execute(C.LINKED_ORACLE).fetchall(), key=repr)
    assert want == sorted(map(tuple, C.chat_format(C.with_calls(df)).collect()), key=repr)
    assert {r[4] for r in want} == {0, 1, 2, 3} and {r[6] for r in want} == {0, 1} and {r[7] for r in want} == {0, 1}
