import pytest
from pyspark.sql import functions as F
from tagweave.functions import numeric as N
from tagweave.functions import text as T


def values(spark, texts, column):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_parse_list(spark):
    cells = ['["a","b"]', "['a', 'b']", "plain", None, "", "(1,2)", "['a',]", "[None]", "[1] tail", "['a', null]", "[1, 2]", " ['x'] ", '["a', "[1] tail]"]
    assert values(spark, cells, T.parse_list("c")) == [
        ["a", "b"], ["a", "b"], ["plain"], [], [""], ["(1,2)"], ["['a',]"], ["[None]"], ["[1] tail"],
        ["['a', null]"], ["1", "2"], ["x"], ['["a'], ["[1] tail]"],
    ]


def test_parse_reviews_json(spark):
    cells = ['[" a ", "", null, 5]', "['a']", None, "  ", "text", '{"a": 1}']
    assert values(spark, cells, T.parse_reviews_json("c")) == [["a", "5"], ["['a']"], [], [], ["text"], ['{"a": 1}']]


def test_parse_tags(spark):
    assert values(spark, [" A ;b;; ; c\t", None, ""], T.parse_tags("c")) == [["A", "b", "c"], [], []]
    assert values(spark, ["Ёж; B"], T.parse_tags("c", lower=True)) == [["ёж", "b"]]


def test_dedupe_ignoring_case(spark):
    assert values(spark, ["a; B ;A;b; c"], T.dedupe_ignoring_case(F.split("c", ";"))) == [["a", "B", "c"]]


def test_build_text(spark):
    rows = [("n ", None, " ", ["a", " ", " b"]), (None, "t", "s", []), ("n", "t", "s", [" ", ""])]
    df = spark.createDataFrame(rows, "n string, t string, s string, c array<string>")
    got = [r[0] for r in df.select(T.build_text("n", "t", "s", "c")).collect()]
    assert got == ["n | a  b", "t | s", "n | t | s | "]


def test_chunk_reviews(spark):
    cases = [["aaa", "bb", "cccccccc", "d", ""], [], ["toolong", "x"], ["aa", "aa", "aa"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<string>")
    got = [r[0] for r in df.orderBy("i").select(T.chunk_reviews("c", 5)).collect()]
    assert got == [[["aaa", "bb"], ["cccccccc"], ["d", ""]], [], [["toolong"], ["x"]], [["aa", "aa"], ["aa"]]]


def test_tag_reply(spark):
    replies = [
        '{"tags": ["a", " b ", 5, null, ""]}',
        '```json {"tags": ["draft"]} ``` and ```JSON\n{"tags": ["last"]}\n```',
        "no braces", 'pre {"tags": "text"} post', '{"tags": ["a"', '{"tags": ["a"]} trailing }', None,
        '{"теги": null, "tags": ["z"]}', '{"теги": ["q"], "tags": ["z"]}', '{"tags": ["a"],}', 'x {"tags": ["in prose"]} y',
    ]
    assert values(spark, replies, T.parse_tag_reply("c")) == [
        ["a", "b", "5"], ["last"], [], [], [], [], [], [], ["q"], [], ["in prose"],
    ]


def test_rerank_reply(spark):
    cand = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("score")) for t, s in (("a", 0.5), ("b", 0.25))])
    replies = [
        '{"tags":[{"tag":"b","score":"0.9"},{"tag":"zz","score":1},{"tag":"a","score":"n/a"},"str",{"tag":"b"},{"score":1}]}',
        '[{"tag":"a","score":1}]', 'hi {"tags":[{"tag":"a","score":0.1}]} bye', "[]", None, 'Sure: [{"tag":"a"}]',
        '{"tags":[{"tag":"a","score":0.1}', '{"tags":"a"}',
    ]
    got = values(spark, replies, T.parse_rerank_reply("c", cand, 3))
    assert [[tuple(x) for x in r] for r in got] == [
        [("b", 0.9), ("a", 0.5), ("b", 0.25)], [("a", 1.0)], [("a", 0.1)], [], [], [], [], [],
    ]
    capped = values(spark, replies[:1], T.parse_rerank_reply("c", cand, 1))
    assert [tuple(x) for x in capped[0]] == [("b", 0.9)]


def test_pool_and_choice_replies(spark):
    reply = '```json {"kept_tags":[" A ","b",""],"mappings":[{"old":["x","Y"],"new":"a"},{"old":"bad","new":"q"},{"old":["d"],"new":""}, 7]} ```'
    got = values(spark, [reply, "nothing"], T.parse_pool_reply("c"))
    assert got[0]["kept"] == ["a", "b"]
    assert [tuple(r) for r in got[0]["rules"]] == [("x", "a", 0), ("y", "a", 0), ("d", "", 2)]
    assert got[1]["kept"] == [] and got[1]["rules"] == []
    assert values(spark, ['{"best_tag": " Soft "}', "?"], T.parse_choice_reply("c")) == ["soft", ""]


def test_prompt_parts(spark):
    df = spark.createDataFrame([(["x", "y"], [("t", 0.1236)], "  long text  ", "")], "r array<string>, c array<struct<tag:string,score:double>>, t string, n string")
    row = df.select(
        T.numbered_lines("r"), T.candidate_lines("c"), T.trim_text("t", 4), T.display_label(F.lit("S1"), "n"),
        T.fill_template("<{a}|{b}|{a}>{z}", a="t", b=F.lit(None)),
    ).first()
    assert tuple(row) == ("1. x\n2. y", "1. t (model_prob=0.124)", "long", "S1 — Без названия", "<  long text  ||  long text  >{z}")


def test_numeric(spark):
    df = spark.createDataFrame([(0.0, -800.0), (1.0, 800.0), (0.5, 0.0)], "p double, x double")
    rows = df.select(N.logit("p"), N.sigmoid("x"), N.sigmoid(N.logit("p"))).collect()
    assert rows[0][0] == pytest.approx(-13.815510, abs=1e-5) and rows[1][0] == pytest.approx(13.815510, abs=1e-5)
    assert [r[1] for r in rows] == [0.0, 1.0, 0.5] and rows[2][2] == 0.5
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = v.select(N.cosine("a", "b"), N.cosine("a", "z")).first()
    assert got[0] == pytest.approx(0.96) and got[1] is None
