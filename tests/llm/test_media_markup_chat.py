import time
import json
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, flac, markup


def payloads():
    rng = np.random.RandomState(1)
    return [b"\0" * 64, b"a" * 100, b"x", rng.randint(0, 256, 9001).astype(np.uint8).tobytes(), bytes((np.sin(np.arange(9000) / 40) * 90 + 128).astype(np.uint8)), "Straße là-bas. ".encode() * 700, bytes([255, 0] * 3000)]


def test_flac_round_trip():
    media = flac.encode(payloads())
    assert [pcm for pcm, _ in flac.decode(media)] == payloads()
    for stream, data in zip(media, payloads(), strict=True):
        bps, total, _, at = flac.read_stream(stream)
        out = []
        while len(out) < total:
            n, head = flac.read_header(stream, at, bps)
            samples, used = flac.decode_slowly(stream[at + head :], n, bps)
            out += samples
            at += head + used + 2
        assert bytes(x + 128 for x in out) == data


def test_flac_blocks_seek():
    (stream,) = flac.encode([bytes(random.Random(2).randrange(60, 90) for _ in range(10_000))])
    ((pcm, blocks),) = flac.decode([stream])
    assert [b[0] for b in blocks] == [0, 4096, 8192]
    first, n, at = blocks[1]
    m, head = flac.read_header(stream, at, 8)
    samples, _ = flac.decode_slowly(stream[at + head :], m, 8)
    assert m == n and bytes(x + 128 for x in samples) == pcm[first : first + n]


def test_flac_reads_predictors_and_partitions():
    """An LPC subframe of order 1 with weight 1 and shift 0, two Rice partitions, the second escaped to raw bits."""
    values = [10, 12, 11, 13, 14, 10, 9, 9]
    left = np.diff(values).tolist()
    bits = "0" + "100000" + "0" + f"{values[0] & 255:08b}" + f"{2 - 1:04b}" + "00000" + f"{1:02b}" + "00" + f"{1:04b}"
    z = [2 * x if x >= 0 else -2 * x - 1 for x in left]
    bits += f"{1:04b}" + "".join("0" * (x >> 1) + "1" + str(x & 1) for x in z[:3])
    bits += "1111" + f"{5:05b}" + "".join(f"{x & 31:05b}" for x in left[3:])
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert flac.decode_slowly(raw + b"tail", 8, 8) == (values, len(raw))


@pytest.mark.parametrize("place", [50, 300, -1])
def test_flac_damage_is_found(place):
    (stream,) = flac.encode([b"some words of text " * 100])
    broken = bytearray(stream)
    broken[place] ^= 4
    with pytest.raises((ValueError, IndexError)):
        flac.decode([bytes(broken)])


def test_flac_column(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (3, "x" * 64), (None, "a" * 9000), (5, "héllo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    back = flac.flac_decode(flac.flac_encode(df))
    got = back.collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r["pcm"]) % 64 == 0 and len(r["pcm"]) > 0
    assert {bytes(r["pcm"]).rstrip(b"\0") for r in got} == {(t or "").encode() for _, t in rows}
    media = {r["doc_id"]: bytes(r["media"]) for r in got}
    assert media[1] == media[5]
    pcm = flac.write_pcm(back, tempfile.mkdtemp(prefix="spark-") + "/pcm")
    assert "media" not in pcm.columns and pcm.count() == len(rows)
    blocks = flac.pcm_blocks(pcm).where("doc_id is null").orderBy("first_sample").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == b"a" * 9000 + b"\0" * 24 and [b["first_sample"] for b in blocks] == [0, 4096, 8192]
    long = pcm.where("doc_id is null")
    for first, n in ((0, 10), (4090, 20), (4096, 4096), (100, 9000), (9020, 50), (99_999, 5)):
        assert bytes(flac.samples_at(long, first, n).first()["pcm"]) == (b"a" * 9000 + b"\0" * 24)[first : first + n]
    digest = {r["doc_id"]: r for r in flac.pcm_digest(pcm).collect()}
    assert digest[None]["payload_bytes"] == 9024 and digest[None]["n_blocks"] == 3 and digest[1]["payload_sha256"] == digest[5]["payload_sha256"]
    assert flac.pcm_digest(flac.write_pcm(back.limit(0), tempfile.mkdtemp(prefix="spark-") + "/pcm")).count() == 0
    assert flac.flac_decode(flac.flac_encode(df.limit(0))).count() == 0


def test_flac_query(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in flac.op9_flac(spark, data).collect():
        p = flac.payload(texts[r["doc_id"]].encode())
        import hashlib

        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<h1>T</h1>x <b>y</b>z<br>w", "T\n\nx yz\nw"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<table><tr><th>Name<th>N<tr><td>Apple<td>3</table>", "Name  | N\nApple | 3"),
    ("a<script>x</script><style>y</style><div hidden>z</div><p style='color:red;display:none'>q</p>b", "ab"),
    ("<pre>  a\n   b</pre>", "  a\n   b"),
    ("<div>one</div><div>two</div>three", "one\ntwo\nthree"),
    ("x &amp; y&nbsp;z &lt;3", "x & y z <3"),
    ("</p></div>stray</b>", "stray"),
    ("", ""),
    ("<", "<"),
    ("<!-- c --><![CDATA[x]]>t", "t"),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\nv\nl\nw"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_visible_text(html, text):
    assert markup.visible_text(html) == text


@pytest.mark.parametrize(("html", "text"), [
    # text of a table that another table's row holds
    ("<table><tr><table>LOST<tr><td>a</td></tr></table></tr></table>", "LOST\n\na"),
    # blocks and lists within a cell keep their lines
    ("<table><tr><td><p>one</p><p>two</p><ul><li>b<li>c</ul><pre>k  k\nm</pre></table>", "one\n\ntwo\n\n- b\n- c\n\nk  k\nm"),
    ("<table><tr><td><p>one</p><p>two</p><td>x<br>y</table>", "one | x\n    | y\ntwo"),
    # rows of a table in a cell stay apart and aligned
    ("<table><tr><td>a<table><tr><td>11<td>2<tr><td>3<td>4444</table></table>", "a\n\n11 | 2\n3  | 4444"),
    # what reaches down or across moves the cells beside it
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><th colspan=1000>head<tr><td>a<td>b<td>c</table>", "head\na | b | c"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>a<td>b<td>c</table>", "ab |   | c\na  | b | c"),
])
def test_layout_of_tables(html, text):
    assert markup.visible_text(html) == text


def test_ill_formed_tables_lose_no_words():
    """Random tags of tables, open and close in any order: every word of the source is in the text once."""
    rng = random.Random(8)
    tags = ["table", "tr", "td", "th", "tbody", "thead", "caption", "div", "p", "ul", "li", "b"]
    for _ in range(600):
        parts, words = [], 0
        for _ in range(rng.randrange(1, 40)):
            kind = rng.random()
            if kind < 0.35:
                parts.append(f" w{words} ")
                words += 1
            else:
                parts.append(f"<{'/' if kind > 0.75 else ''}{rng.choice(tags)}{rng.choice(['', '', ' colspan=2', ' rowspan=3']) if kind <= 0.75 else ''}>")
        got = markup.visible_text("".join(parts))
        assert sorted(re.findall(r"w\d+", got)) == sorted(f"w{i}" for i in range(words)), "".join(parts)


def test_deep_and_broken_pages():
    assert markup.visible_text("<div>" * 5000 + "deep").strip() == "deep"
    assert markup.visible_text("<table>" * 40 + "x") is not None
    for html in ("<![foo bar]>t", "<!DOCTYPE", "<a href='", "&#xFFFFFFFF;", "<p" * 200):
        assert isinstance(markup.visible_text(html), str)


@pytest.mark.parametrize(("html", "text"), [
    ("<table><form><tr><td>a<td>b</form></table>", "a | b"), ("<table><tr><form><td>x</td></form></tr></table>", "x"), ("<table><div>text</div><tr><td>c</table>", "text\n\nc"), ("<table>loose<tr><td>d</table>", "loose\n\nd"),
    ("<head><title>t</title>inline <b>bold</b><p>para", "inline bold\n\npara"), ("<svg><title>no</title><text>Sv</text></svg><math><mi>x</mi></math>", "Svx"), ("<table><tr><td>a<table><tr><td>in1<td>in2</table><td>b</table>", "a         | b\n\nin1 | in2"),
    ("<table><tr><td>a<table><tr><td><td>x<tr><td><td></table></table>", "a\n\nx"),
])
def test_what_tables_and_heads_hold(html, text):
    assert markup.visible_text(html) == text


@pytest.mark.parametrize("tag", ["<div>", "<span>", "<ul><li>", "<p><b>", "<table><td><p>x<div>", "<table><tr><td>x", "<svg><a>", "</div><div>"])
def test_depth_costs_nothing(tag):
    began = time.process_time()
    markup.visible_text(tag * 100_000)
    assert time.process_time() - began < 60


def random_page(rng, depth=0):
    """A well-formed fragment, and the words that a reader sees of it, made together with it."""
    word = f"w{rng.randrange(10**6)}"
    kind = rng.choice(["text", "block", "inline", "hidden", "list", "table"] if depth < 5 else ["text"])
    if kind == "text":
        return word + " ", [word]
    inside = [random_page(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    html, seen = "".join(h for h, _ in inside), [w for _, ws in inside for w in ws]
    if kind == "block":
        return (lambda t: (f"<{t}>{html}</{t}>", seen))(rng.choice(["div", "section", "blockquote", "article"]))
    if kind == "inline":
        return f"<span>{html}</span> ", seen
    if kind == "hidden":
        return rng.choice(["<div hidden>{}</div>", "<div style='display:none'>{}</div>", "<template>{}</template>"]).format(html), []
    if kind == "list":
        return "<ul>" + "".join(f"<li>{h}</li>" for h, _ in inside) + "</ul>", seen
    return "<table>" + "".join(f"<tr><td>{h}</td><td>{word}</td></tr>" for h, _ in inside) + "</table>", [w for _, ws in inside for w in [*ws, word]]


def test_no_visible_word_is_lost_or_moved():
    for seed in range(300):
        html, seen = random_page(random.Random(seed))
        got = [w for w in markup.visible_text(html).split() if w not in ("|", "-")]
        # lines of cells that stand side by side alternate
        assert sorted(got) == sorted(seen) and ("<table" in html or got == seen)


def test_empty_pages_table(spark):
    assert markup.extract(spark.createDataFrame([], "page_id long, html string, title string")).count() == 0


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<title> A  b</title><p>x"), (2, "u", None), (2, "u", ""), (None, None, "<p>y<p>z")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r["page_id"], r["title"], r["text"], r["n_lines"]) for r in markup.extract(df).collect()}
    assert got == {(1, "A b", "x", 1), (2, None, "", 0), (None, None, "y\n\nz", 3)}


def test_canonical_json():
    assert chat.canonical({"b": 1.0, "a": ["é", None, True, 0.5]}) == '{"a":["é",null,true,0.5],"b":1}'


def test_problems():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "additionalProperties": False}
    assert chat.problems({"a": 1, "b": ["x"]}, schema) == []
    assert chat.problems({"a": 0.5, "b": ["xyz"], "c": 1}, schema) == ["$.a: not integer", "$.b[0]: length out of bounds", "$.c: unknown"]
    assert chat.problems([], schema) == ["$: not object"] and chat.problems({"a": True}, schema) == ["$.a: not integer"]


def test_topological_order():
    call = lambda i, *after: {"id": i, "after": list(after)}
    assert chat.topological([call("c", "b"), call("b", "a"), call("a")]) == ([2, 1, 0], set())
    assert chat.topological([call("a", "b"), call("b", "a"), call("c", "zz")]) == ([2, 0, 1], {0, 1})


HOSTILE = ["[" * 100_000 + "]" * 100_000, '{"a":' * 30_000 + "1" + "}" * 30_000, '{"text":NaN}', '{"text":-Infinity}', '{"text":1e999}', "9" * 5000, '{"text":"\\ud800"}', "{bad", "\x00", '{"text":"q"} x']


@pytest.mark.parametrize("text", HOSTILE)
def test_hostile_arguments(text):
    value, form, error = chat.parsed(text)
    assert (value, form) == (None, None) and error in ("$: not JSON", "$: nested too deeply")


def test_schemas_of_any_kind():
    assert chat.problems(1, {"type": "odd"}) == ["$: the schema has an unknown type odd"] and chat.problems(1, False) == ["$: not allowed"] and chat.problems(1, True) == []
    assert chat.problems(True, {"enum": [1]}) and not chat.problems(1.0, {"enum": [1]}) and not chat.problems(None, {"type": ["null", "string"]})
    assert chat.problems({"x": 1}, {"additionalProperties": {"type": "string"}}) == ["$.x: not string"]


def test_random_orders():
    rng = random.Random(5)
    for _ in range(300):
        calls = [{"id": rng.choice("abcdefgh") if rng.random() < 0.9 else None, "after": rng.sample("abcdefghz", rng.randrange(3))} for _ in range(rng.randrange(9))]
        order, stuck = chat.topological(calls)
        first = {c["id"]: i for i, c in reversed(list(enumerate(calls))) if c["id"] is not None}
        waits = [{first[a] for a in c["after"] if a in first} for c in calls]
        done, want = set(), []
        while (free := next((i for i in range(len(calls)) if i not in done and waits[i] <= done), None)) is not None:
            want.append(free)
            done.add(free)
        assert order[: len(want)] == want and stuck == set(range(len(calls))) - done and sorted(order) == list(range(len(calls)))


MESSAGE = f"conv_id long, turn long, role string, content string, calls array<{chat.CALL}>, json string, status int"
RESULT = "conv_id long, call_id string, turn long, content string"


def test_links(spark):
    call = lambda *c: dict(zip(("id", "name", "arguments", "after"), c, strict=True))
    calls = [call("b", "answer", '{"question":"q","words":2}', ["a"]), call("a", "measure", '{"text":"q"}', None), call("x", "none", "{}", ["b", None]), call("y", "measure", "{bad", ["z", "nobody"]), None, call("n", "measure", HOSTILE[0], [])]
    messages = spark.createDataFrame([(1, 0, "assistant", "so", calls, "clash", 1), (1, 1, "assistant", None, [call("z", "measure", '{"text":"q"}', ["a"])], None, None), (2, 0, "user", "hi", None, None, None), (3, 0, None, "é", [], None, None), (None, None, None, None, [call(None, None, None, None)], None, None)], MESSAGE)
    results = spark.createDataFrame([(1, "b", 2, "late"), (1, "b", 1, "first"), (1, "q", 1, "lost"), (1, None, 1, "nameless"), (9, "a", 1, "elsewhere"), (1, "z", 0, "soon")], RESULT)
    got = chat.formatted(messages, results, chat.TOOLS).collect()
    rows = {(r["conv_id"], r["call_id"]): r for r in got if r["status"] != "message"}
    assert {k: r["status"] for k, r in rows.items()} == {(1, "a"): "unanswered", (1, "b"): "linked", (1, "x"): "unanswered", (1, "y"): "unanswered", (1, "n"): "unanswered", (1, "z"): "early", (1, "q"): "orphan", (9, "a"): "orphan", (None, None): "unanswered"}
    assert [rows[1, k]["place"] for k in "abxyn"] == [0, 1, 2, 3, 4] and rows[1, "b"]["content"] == "first"
    assert rows[1, "x"]["errors"] == ["unknown tool"] and rows[1, "z"]["errors"] == [] and rows[1, "n"]["errors"] == ["$: nested too deeply"]
    assert rows[1, "y"]["errors"] == ["$: not JSON", "waits for a later call: z", "waits for an unknown call: nobody"]
    assert json.loads(rows[1, "b"]["json"]) == {"id": "b", "status": "linked", "result": "first", "name": "answer", "arguments": {"question": "q", "words": 2}}
    said = {(r["conv_id"], r["turn"]): r["json"] for r in got if r["status"] == "message"}
    assert len(said) == 5 and said[2, 0] == '{"content":"hi","role":"user"}' and said[3, 0] == '{"content":"é","role":null}'
    assert [c["id"] for c in json.loads(said[1, 0])["tool_calls"]] == ["a", "b", "x", "y", "n"]
    assert chat.formatted(messages.limit(0), results.limit(0), chat.TOOLS).count() == 0


def test_random_links(spark):
    rng = random.Random(9)
    calls = [(c, t, "assistant", None, [{"id": rng.choice("abcd"), "name": "measure", "arguments": "{}", "after": rng.sample("abcde", 1)} for _ in range(rng.randrange(3))], None, None) for c in range(8) for t in range(3)]
    results = [(rng.randrange(9), rng.choice("abcde"), rng.randrange(4), f"r{i}") for i in range(40)]
    got = chat.formatted(spark.createDataFrame(calls, MESSAGE), spark.createDataFrame(results, RESULT), chat.TOOLS).where("status <> 'message'").collect()
    made = [(c, t, x["id"], x["after"][0]) for c, t, _, _, xs, _, _ in calls for x in xs]
    want = []
    for c, t, i, after in made:
        hits = sorted((u, text) for d, j, u, text in results if (d, j) == (c, i))
        turns = [u for d, u, j, _ in made if (d, j) == (c, after)]
        own = [j for d, u, j, _ in made if (d, u) == (c, t)]
        waits = "" if turns and min(turns) <= t else "waits for a later call: " + after if turns else "waits for an unknown call: " + after
        want.append((c, t, i, "unanswered" if not hits else "early" if hits[0][0] < t else "linked", hits[0][1] if hits else None, waits, after in own))
    assert sorted((r["conv_id"], r["turn"], r["call_id"], r["status"], r["content"] or "", (r["errors"] or [""])[-1] if r["errors"] and r["errors"][-1].startswith("waits for") else "") for r in got if r["status"] != "orphan") == sorted((c, t, i, s, x or "", w) for c, t, i, s, x, w, _ in want)
    assert {(r["conv_id"], r["call_id"]) for r in got if r["status"] == "orphan"} == {(c, i) for c, i, _, _ in results} - {(c, i) for c, _, i, _ in made}


def test_conversations(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    rows = chat.op8_tool_calls(spark, data).collect()
    by = {(r["conv_id"], r["turn"]): r for r in turns.collect()}
    users = {k for k, r in by.items() if r["role"] == "user"}
    linked = {(r["conv_id"], r["turn"]) for r in rows if r["name"] == "answer" and r["status"] == "linked"}
    assert linked == {(c, t) for c, t in users if (c, t + 1) in by and by[c, t + 1]["role"] != "user"}
    assert sum(r["status"] == "orphan" for r in rows) == sum(1 for (c, t), r in by.items() if r["role"] != "user" and (c, t - 1) not in users)
    odd = spark.createDataFrame([(1, 0, "user", None), (1, None, "user", "x"), (None, 0, "assistant", "y"), (2, 0, None, "z")], "conv_id long, turn long, role string, text string")
    messages, results = chat.from_turns(odd)
    got = chat.formatted(messages, results, chat.TOOLS)
    assert got.where("status = 'message'").count() == 4 and got.where("status <> 'message'").count() == 4
