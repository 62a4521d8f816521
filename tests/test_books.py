import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import segment
from quirework.operators.rules import Rules, load_rules, normalize, save_rules


def books(spark, texts, entries=()):
    return spark.createDataFrame([(str(i), x, list(entries)) for i, x in enumerate(texts)], "book_id string, text string, entries array<string>")


def parsed(spark, text, rules=None, entries=()):
    rows = segment.parse_text(books(spark, [text], entries), rules).orderBy("chapter_no").collect()
    return [(r.title, r.content) for r in rows]


@pytest.mark.parametrize(
    "text, rules, entries, want",
    [
        ("晨光初现\n正文甲。\n夜色渐深\n正文乙。", {}, ["晨光初现", "夜色渐深"], [("晨光初现", "正文甲。<br/>"), ("夜色渐深", "正文乙。<br/>")]),
        ("序章 风起\n他来了。", {}, [], [("序章 风起", "他来了。<br/>")]),
        ("第一章 开始\n第二天章鱼出现了\n正文", {}, [], [("第一章 开始", "第二天章鱼出现了正文")]),
        ("第一章 开始\n甲\n第二天章鱼出现了\n正文", {"strictNumberMode": False}, [], [("第一章 开始", "甲"), ("第二天章鱼出现了", "正文")]),
        ("第一章 开始\n第二天章鱼出现了\n正文", {"strictNumberMode": False}, [], [("第一章 开始 第二天章鱼出现了", "正文")]),
        ("第一卷 起\n正文", {"chapterKeywords": ["卷"], "chapterSuffixes": ["卷"]}, [], [("第一卷 起", "正文")]),
        ("第一章\u3000名字\n广告：看书\n正文", {"ignorePatterns": ["^广告"]}, [], [("第一章 名字", "正文")]),
        ("第一章\n楔子 出发\n正文", {}, [], [("第一章 楔子 出发", "正文")]),
        ("第一章\n楔子 出发\n正文", {"maxTitleLength": 8}, [], [("第一章", "第一章"), ("楔子 出发", "正文")]),
        ("序章\n第一章 出发\n正文", {}, [], [("序章", "序章"), ("第一章 出发", "正文")]),
        ("第一章 甲\n正文\n第二章 乙", {}, [], [("第一章 甲", "正文")]),
        ("开头一句。\n还有。\n第一章 甲\n正文", {}, [], [("开头一句。", "开头一句。<br/>\n还有。<br/>"), ("第一章 甲", "正文")]),
    ],
)
def test_chapters(spark, text, rules, entries, want):
    assert parsed(spark, text, normalize(rules), entries) == want


def test_verse_keeps_breaks(spark):
    assert parsed(spark, "第一章 诗\n春眠不觉晓\n\n处处闻啼鸟\n\n花落知多少")[0][1] == "春眠不觉晓<br/>\n处处闻啼鸟<br/>\n花落知多少"


def test_empty_books(spark):
    assert segment.parse_text(books(spark, ["", "\n \n"])).count() == 0


def test_rules(tmp_path):
    r = normalize({"minTitleLength": "x", "maxTitleLength": -3, "chapterSuffixes": "章，回", "ignorePatterns": ["(", "^a"], "titleStarts": []})
    assert (r.minTitleLength, r.maxTitleLength, r.chapterSuffixes, r.ignorePatterns, r.titleStarts) == (2, 20, ("章", "回"), ("^a",), Rules().titleStarts)
    assert normalize({"minTitleLength": 30, "maxTitleLength": 10}) == Rules()
    path = str(tmp_path / "a" / "rules.json")
    assert load_rules(path) == Rules()
    save_rules(path, {"maxTitleLength": 9})
    assert load_rules(path).maxTitleLength == 9


def test_paragraphs_equal_a_fold(spark):
    import re

    random.seed(5)
    docs = [[random.choice(["短", "没有句号的一行文字", "句子完了。", "a b", "long enough line", "end!", " "]) for _ in range(random.randint(0, 9))] for _ in range(60)]
    rows = spark.createDataFrame([(d, i, x) for d, ls in enumerate(docs) for i, x in enumerate(ls)], "doc_id int, pos int, line string")
    got = {}
    for r in segment.paragraphs(rows).orderBy("doc_id", "paragraph_no").collect():
        got.setdefault(r.doc_id, []).append(r.paragraph)
    for d, ls in enumerate(docs):
        want = []
        for x in filter(None, (re.sub(r"\s+", " ", y).strip() for y in ls)):
            if want and want[-1][-1] not in "。！？；：…—”\"'）】》」』〕)]．.!?;" and len(want[-1]) >= 8:
                want[-1] += x
            else:
                want.append(x)
        assert got.get(d, []) == want


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(t.title_text(F.lit(" 《 书 名 》 "))) == "书 名"
    assert one(t.unescape(F.lit("&lt;&#65;&#x4e2d;&amp;lt;&#xD800;&copy;&nbsp;"))) == "<A中&lt;&copy; "
    assert one(t.clean_title(F.lit("<b>a</b>\u3000&amp; b"))) == "a & b"
    assert one(t.html_to_text(F.lit("<p>a<br>b</p><script>x</script><p> c </p>"))) == "a\nb\nc"
    assert one(t.block_style(F.lit("color:red; display : inline"))) == "display:block; color:red"
    assert one(t.js_length(F.lit("a🙂"))) == 3
    assert one(t.is_placeholder(F.lit("data:image/gif;base64,R0"))) and not one(t.is_placeholder(F.lit("a.png")))
    assert one(t.image_url(F.lit("/i"), id=F.lit("a b"))) == "/i?id=a%20b"
    assert one(t.safe_file_name(F.lit('a/b:c?. '))) == "a_b_c_"
    assert one(t.sniff_image(F.lit(bytearray(b"\x89PNG\r\n\x1a\n")))) == "image/png"
    assert one(t.data_uri(F.lit("image/png"), F.lit(bytearray(b"x" * 90)))).count("\n") == 0
    assert one(t.decode_text(F.lit(bytearray('<?xml encoding="GBK"?>中'.encode("gbk"))))) == '<?xml encoding="GBK"?>中'
    assert one(t.json_for_script(F.lit("</script>"))) == "\\u003c/script>"


def test_registered_queries_equal_their_sql(spark):
    import duckdb

    from quirework.plans.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    import glob
    import os

    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == cols, name
        assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in cols]).fetchall())), name
