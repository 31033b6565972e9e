"""Operator 6: exact round trip and digests."""

import json

import brute
import pytest

from sitelume.llm import chat


def test_turn_round_trip():
    for text in ["", "a\\b", "\\<turn:x\\>y\\</turn>", "\\\\", "\\", "\\</loss>\\", "é\n\x00", "\\### Assistant: </turn> ok"]:
        for role in ["user", "assistant", "", "sys\\>tem"]:
            assert list(chat.read_turns(chat.format_turn(role, text) * 2)) == [(role, text, role == "assistant")] * 2


def expected(rows):
    """Digests of conversations; a row without a conversation is told by its text."""
    by = {}
    for r in rows:
        by.setdefault((r["conv_id"], r["text"] if r["conv_id"] is None else None), []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[c[0] if c[0] is not None else c] = (len(turns), brute.sha("".join(f"{role}\n{t}\n" for *_, role, t in turns)), len(loss), brute.sha(loss), sum(len(chat.format_turn(role, t)) for *_, role, t in turns))
    return out


def test_digest(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", None), (2, 0, None, "x"), (None, None, "assistant", "q"), (None, None, "user", "r"), (None, 0, "user", "r s"), (1, 1, "assistant", "b\\"), (3, 5, "assistant", "é" * 200_000), (3, 4, "tool", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 formatted", "2 attachments")
    got = {r.conv_id: tuple(r)[1:6] for r in chat.digest(chat.probe(turns)).filter("conv_id is not null").collect()}
    said = r"\### Assistant: </turn> ok"
    want = expected([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]])
    alone = sorted(v for k, v in want.items() if isinstance(k, tuple))
    assert sorted(tuple(r)[1:6] for r in chat.digest(turns).filter("conv_id is null").collect()) == alone and len(alone) == 3
    assert got == {k: v for k, v in want.items() if not isinstance(k, tuple)}
    assert chat.digest(turns.limit(0)).count() == 0


def test_many_rows_without_a_conversation(spark):
    """They are dealt evenly: no partition has most of them."""
    turns = spark.range(20_000).selectExpr("cast(null as long) conv_id", "0 turn", "'user' role", "cast(id as string) text")
    out = chat.digest(turns)
    assert out.count() == 20_000 and {r.n_turns for r in out.select("n_turns").distinct().collect()} == {1}
    sizes = [r["count"] for r in chat.formatted_turns(chat.flatten(turns)).selectExpr("pmod(hash(conv_id, xxhash64(turn, role, text)), 8) p").groupBy("p").count().collect()]
    assert max(sizes) < 3000


def test_placeholders_are_told_from_texts(spark):
    said = r"a <image:0> \<image:0> \\<audio:1> b"
    parts = json.dumps([{"type": "text", "text": said}, {"type": "image", "url": "x"}, {"type": "text", "text": "<image:0>"}, {"type": "audio", "ref": "y"}, {"type": "audio", "ref": "z"}])
    turns = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", parts), (1, 2, r"us\<image:0>er", "")], "conv_id long, turn long, role string, text string")
    rows = chat.formatted_turns(chat.flatten(turns)).orderBy("turn").collect()
    got = list(chat.read_parts("".join(r.formatted for r in rows)))
    assert got == [
        ("user", [(False, said)], False),
        ("assistant", [(False, said), (True, "image:0"), (False, "<image:0>"), (True, "audio:1"), (True, "audio:2")], True),
        (r"us\<image:0>er", [], False),
    ]
    assert [t for _, t, _ in chat.read_turns(rows[1].formatted)] == [rows[1].text] == [said + "<image:0><image:0><audio:1><audio:2>"]


def test_small_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert {r.conv_id: tuple(r)[1:6] for r in chat.digest(turns).collect()} == expected([r.asDict() for r in turns.collect()])


def test_formatting_in_both_places(spark, odd_docs):
    turns = odd_docs.selectExpr("doc_id conv_id", "1 turn", "if(doc_id % 2 = 0, 'assistant', 'us\\\\er') role", "text")
    for r in chat.formatted_turns(chat.flatten(turns)).collect():
        assert r.formatted == chat.format_turn(r.role, r.text)


@pytest.mark.parametrize("content,text,tokens", [
    ("plain [text]", "plain [text]", 0),
    ("[not json", "[not json", 0),
    ("[1, 2]", "[1, 2]", 0),
    ('[{"type":"text","text":"see "},{"type":"image","url":"a.png","width":1024,"height":512},{"type":"text","text":" and "},{"type":"audio","ref":"b","seconds":2.0},{"type":"document","url":"c.pdf","pages":3}]', "see <image:0> and <audio:1><document:2>", 512 + 50 + 1536),
    (None, "", 0),
])
def test_flatten(spark, content, text, tokens):
    r = chat.flatten(spark.createDataFrame([(1, 0, "user", content)], "conv_id long, turn long, role string, text string")).first()
    assert (r.text, r.expanded_tokens) == (text, tokens)
    assert [a.place for a in r.attachments] == list(range(len(r.attachments)))


PLAIN = [
    "[]", " [ ] ", '[ {"type":"x","b":1,"a":2} ]', '[{"type":"text","text":"a"}, {"type":"tool_call","name":"f","args":{"z": 1, "a": [] }}]', '[{"type": "text", "text": {"type":"x"}}]', '[{"type":"text","text":true}]',
    '[{"type":["text"]}]', '[{"a":1}]', '[{"type":"image"}, 3]', '[{"type":"text","text":1.50}]', "[[]]", "[null]", '[{"type":"text"', '{"type":"text","text":"a"}',
]


def test_other_lists_stay_as_they_are(spark):
    """A text that isn't typed parts is kept byte for byte, and under the loss mask."""
    rows = [(k, turn, role, t) for k, t in enumerate(PLAIN) for turn, role in enumerate(("user", "assistant"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = expected([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows])
    got = {r.conv_id: tuple(r)[1:] for r in chat.digest(turns).collect()}
    assert {k: v[:5] for k, v in got.items()} == want and {v[5:] for v in got.values()} == {(0, 0)}


def test_query_visits_parts(spark, tmp_path):
    parts = '[{"type":"text","text":"see "},{"type":"image","url":"a.png"},{"type":"audio","ref":"b","seconds":2}]'
    page, deep = '[{"type":"document","url":"c.pdf","pages":2}]', "[" * 200_000
    nested = '[{"type":"text","text":' + "[" * 1500 + "]" * 1500 + "}]"
    bad = r'[{"type":"image","width":"wide","height":1e999},{"type":"document","pages":-3},{"type":"text","text":5},{"type":"text","text":"\ud83d"}]'
    rows = [(1, 0, "user", parts), (1, 1, "assistant", "plain"), (1, 2, "assistant", page), (2, 0, "user", deep), (3, 0, "user", bad), (4, 0, "user", nested)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from sitelume.llm import queries

    flat = [(1, 0, "user", "see <image:0><audio:1>"), (1, 1, "assistant", "plain"), (1, 2, "assistant", "<document:0>"), (2, 0, "user", deep), (3, 0, "user", "<image:0><document:1>5\ufffd"), (4, 0, "user", nested)]
    want = expected([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in flat])
    marks, tokens = {1: 3, 2: 0, 3: 2, 4: 0}, {1: 256 + 50 + 1024, 2: 0, 3: 256 + 512, 4: 0}
    want = {k: (*v[:4], v[4] + marks[k], marks[k], tokens[k]) for k, v in want.items()}  # a placeholder's mark is a backslash more
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op6_chat_formatting"](spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in want} == want
    more = {r.conv_id: r for r in queries.QUERIES["chat_attachments"](spark, str(tmp_path)).collect()}
    assert {k: tuple(r)[1:8] for k, r in more.items()} == got
    assert [tuple(a) for a in more[1].attachments] == [(0, "image", "a.png", 0, 256), (0, "audio", "b", 1, 50), (2, "document", "c.pdf", 0, 1024)]
    assert [more[k].expanded_tokens for k in (1, 2, 3, -7)] == [256 + 50 + 1024, 0, 256 + 512, 0]
