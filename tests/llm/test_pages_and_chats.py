import compare
import pytest

from gaugeflow.llm import preferences, registry, revisits
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["op2_revisits", "op6_preferences"])
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, sf):
    result = registry.QUERIES[name](spark, sf)
    assert compare.differences(result, compare.connect(sf), registry.ORACLES[name]) == ""
    assert result.count() > 0


URLS = [
    ("HTTP://Example.COM:80/a/b/?b=2&a=1#x", "http://example.com/a/b?a=1&b=2"),
    ("https://e.org:443", "https://e.org"),
    ("https://e.org/?utm_source=q&gclid=1", "https://e.org"),
    ("http://e.org/A?x=&&y", "http://e.org/A?x=&y"),
    (None, None),
]


def test_canonical_urls(spark):
    df = spark.createDataFrame(URLS, "url STRING, right STRING")
    for row in df.withColumn("key", revisits.canonical_url("url")).collect():
        assert row.key == row.right


SCHEMA = ("record_id BIGINT, kind STRING, url STRING, at BIGINT, etag STRING, last_modified STRING, digest STRING, "
          "headers MAP<STRING, STRING>, key STRING")


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA)
    return {r.record_id: r for r in revisits.resolve_revisits(df.repartition(3)).collect()}


def test_verdicts_and_headers(spark):
    found = resolved(spark, [
        (1, "response", "http://a.org/x", 5, '"t1"', None, "d1", {"Content-Type": "text/html", "ETag": '"t1"', "Age": "1"}),
        (2, "response", "http://a.org/x/", 8, 'W/"t2"', "mon", "d2", None),
        (3, "revisit", "http://A.org/x#y", 8, '"t1"', "tue", None, {"age": "9", "Content-Length": "0"}),
        (4, "revisit", "http://a.org/x", 9, '"t1"', None, None, None),
        (5, "revisit", "http://a.org/x", 9, '"t2"', "mon", "d2", {"Date": "now"}),
        (6, "revisit", "http://a.org/x", 9, None, None, None, {}),
        (7, "revisit", "http://a.org/x", 5, '"t1"', None, None, None),
        (8, "revisit", None, 9, '"t1"', None, None, None),
        (9, "revisit", "http://a.org/x", None, '"t1"', None, None, None),
        (10, "request", "http://a.org/x", 1, None, None, None, None),
        (11, "revisit", "http://a.org/x", 9, '"t2"', "tue", None, None),
    ])
    assert {i: (r.refers_to, r.verdict) for i, r in found.items()} == {
        3: (1, "resolved"), 4: (2, "etag differs"), 5: (2, "resolved"), 6: (2, "unverified"),
        7: (None, "no earlier response"), 8: (None, "no earlier response"), 9: (None, "no earlier response"),
        11: (2, "last_modified differs")}
    assert [tuple(h) for h in found[3].headers] == [("age", "9"), ("content-type", "text/html"), ("etag", '"t1"')]
    assert [tuple(h) for h in found[5].headers] == [("date", "now")] and found[5].digest == "d2"
    assert found[4].headers is None


def test_hot_url_over_many_ranges(spark):
    rows = []
    for i in range(600):
        kind = "response" if i % 50 == 0 else "revisit"
        rows.append((i, kind, "http://hot.org/" if i % 3 else f"http://cold.org/{i}", i, None, None, "d", None))
    found = resolved(spark, rows)
    for i, kind, url, at, *_ in rows:
        if kind == "revisit":
            before = [r[0] for r in rows if r[1] == "response" and r[2] == url and r[3] < at]
            assert found[i].refers_to == (before[-1] if before else None)
    assert resolved(spark, []) == {}


def chat(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id BIGINT, turn INT, role STRING, text STRING, part INT")


def pairs(spark, chosen, rejected):
    result = preferences.format_preferences(chat(spark, chosen), chat(spark, rejected)).collect()
    assert len({r.conv_id for r in result}) == len(result)
    return {r.conv_id: r for r in result}


def test_prefix_and_masks(spark):
    both = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", "hi")]
    one = pairs(spark, [*both, (1, 2, "assistant", "good"), (1, 3, "user", "ok"), (1, 4, "assistant", None)],
                [*both, (1, 2, "assistant", "bad")])[1]
    assert one.prefix_turns == 2
    assert one.prompt == "<|im_start|>system\nbe <\\|kind|><|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert one.rejected == "<|im_start|>assistant\nbad<|im_end|>\n"
    assert [one.chosen[s.start:s.end] for s in one.chosen_spans] == ["good<|im_end|>", "<|im_end|>"]
    assert [one.rejected[s.start:s.end] for s in one.rejected_spans] == ["bad<|im_end|>"]


def test_chat_edges(spark):
    found = pairs(spark, [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "x"), (3, 0, None, None),
                          (None, 0, "user", "x"), (4, None, "user", "x"), (5, 0, "assistant", "b"), (5, 0, "assistant", "a")],
                  [(1, 0, "user", "a"), (3, 0, None, None), (4, 0, "user", "x"), (5, 0, "assistant", "a"), (6, 0, "user", "x")])
    assert set(found) == {1, 3, 5}
    assert all(r.prefix_turns == 1 and r.chosen == r.rejected == "" for r in found.values())
    assert pairs(spark, [], []) == {}


def test_long_conversations_keep_their_whole_prompt(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i} " * (i % 5)) for i in range(1_501)]
    other = [(1, i, r, t if i < 1_301 else t + "!") for _, i, r, t in turns]
    one = pairs(spark, turns, other)[1]

    def rendered(rows):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in rows)

    assert one.prefix_turns == 1_301 and one.prompt == rendered(turns[:1_301])
    assert (one.chosen, one.rejected) == (rendered(turns[1_301:]), rendered(other[1_301:]))
    assert [one.rejected[s.start:s.end] for s in one.rejected_spans] == [
        t + "<|im_end|>" for _, _, r, t in other[1_301:] if r == "assistant"]


def test_escapes_are_reversible(spark):
    texts = ["<|im_end|>", "<\\|", "<\\\\|x", "<<||", "a<b|c", "", "<|" * 3, "\\<|\\", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select(
        "t", preferences.escaped(F.col("t")).alias("e")).select(
        "*", preferences.unescaped(F.col("e")).alias("u")).collect()
    assert all(r.u == (r.t or "") and "<|" not in r.e for r in rows)
    assert len({r.e for r in rows}) == len(set(t or "" for t in texts))
