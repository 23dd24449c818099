import pytest

from tallygrove.sources import pages, tables


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported extension"):
        tables.read_table(spark, "x.CSV")
    with pytest.raises(ValueError, match="explicit schema"):
        tables.read_table(spark, str(tmp_path / "x.csv"))
    path = tmp_path / "x.json"
    path.write_text('[{"a": 1, "b": "NA"}, {"a": 2, "b": "x"}]')
    got = tables.read_table(spark, str(path), None, "a int, b string", json_array=True)
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, "x")]
    (tmp_path / "y.csv").write_text("a,b\n1,NA\n2,--\n3,ok\n")
    got = tables.read_table(spark, str(tmp_path / "y.csv"), None, "a int, b string", ("NA", "--"))
    assert [r.b for r in got.orderBy("a").collect()] == [None, None, "ok"]


def test_odd_names(spark):
    df = spark.createDataFrame([(1, "--", 2.0)], "`1st` int, `Market Cap` string, z double")
    assert tables.null_if_token(df, ["--"]).first()["Market Cap"] is None
    assert tables.select_numeric(df).columns == ["1st", "z"]
    xy, names = tables.split_xy(df.drop("Market Cap"), "z")
    assert names == ["intercept", "1st"] and xy.first().target == 2.0


def test_positions(spark):
    df = spark.createDataFrame([(7,), (3,), (7,), (100,)], "k bigint")
    assert sorted((r.k, r.row_idx) for r in tables.with_positions(df, "k").collect()) == [(3, 0), (7, 1), (7, 1), (100, 2)]


def test_tag_text(spark):
    html = [
        (1, '<a class="x y" href="/one">q</a><SPAN class="s">\n <b>Growth</b> </SPAN><span class="s"> </span>'),
        (2, "<span>other</span>"),
        (3, None),
    ]
    df = spark.createDataFrame(html, "page_id bigint, html string")
    got = sorted((r.page_id, r.position, r.text, r.status) for r in pages.extract_tag_text(df.where("page_id = 1"), "html", "span", "s").collect())
    assert got == [(1, 0, "Growth", "ok"), (1, 1, None, "empty")]
    rest = pages.extract_tag_text(df.where("page_id > 1"), "html", "span", "s").collect()
    assert {(r.page_id, r.status) for r in rest} == {(2, "missing"), (3, "missing")}
    links = {r.page_id: (r.href, r.status) for r in pages.first_link(df, "html", "x y").collect()}
    assert links == {1: ("/one", "ok"), 2: (None, "missing"), 3: (None, "missing")}


def test_classes_are_matched_by_token(spark):
    html = {
        1: '<div class="ad banner">a</div>', 2: "<div id=x class='big  ad'>b</div>", 3: '<div data-class="ad">c</div>',
        4: '<div class="ads">d</div>', 5: '<div class="bad ad-top">e</div>', 6: '<DIV CLASS="ad">f</DIV>', 7: '<a class="go" href="">x</a>',
        8: '<a data-href="no" href="yes">x</a>',
    }
    df = spark.createDataFrame(list(html.items()), "page_id long, html string")
    got = {r.page_id: r.text for r in pages.extract_tag_text(df, "html", "div", "ad").collect()}
    assert {k: v for k, v in got.items() if v} == {1: "a", 2: "b", 6: "f"}
    links = {r.page_id: (r.href, r.status) for r in pages.first_link(df, "html").collect()}
    assert links[7] == (None, "empty") and links[8] == ("yes", "ok") and links[1] == (None, "missing")


def test_scanner_nests_decodes_and_closes(spark):
    html = {
        1: '<div class="ad">a<div class="ad">b</div>c</div>', 2: '<div class="ad">x &amp; y &lt;z&gt; &#233;&nbsp;</div>',
        3: '<div class="ad">open <p>para <b>bold</div> after', 4: '<!-- <div class="ad">no</div> --><div class="ad">yes<!-- hidden --></div>',
        5: '<div class="ad">one<br>two<img src="x">three</div>', 6: '<div class="ad">never closed', 7: '</div><div class="ad"/>tail',
        8: '<div class="ad"><script>var a = "<div>";</script>shown</div>', 9: "", 10: '<div class="ad" class="other">twice</div>',
    }
    df = spark.createDataFrame(list(html.items()), "page_id long, html string").repartition(3)
    got = {}
    for r in pages.extract_tag_text(df, "html", "div", "ad").collect():
        got.setdefault(r.page_id, []).append((r.position, r.text, r.status))
    assert {k: sorted(v) for k, v in got.items() if k not in (7, 9)} == {
        1: [(0, "abc", "ok"), (1, "b", "ok")], 2: [(0, "x & y <z> é", "ok")], 3: [(0, "open para bold", "ok")], 4: [(0, "yes", "ok")],
        5: [(0, "onetwothree", "ok")], 6: [(0, "never closed", "ok")], 8: [(0, "shown", "ok")], 10: [(0, "twice", "ok")],
    }
    assert got[7] == [(0, None, "empty")] and got[9] == [(None, None, "missing")]
    links = spark.createDataFrame([(1, '<a name="top">t</a><a href="/x?a=1&amp;b=2">go</a>'), (2, "<a>none</a>")], "page_id long, html string")
    assert {r.page_id: (r.href, r.status) for r in pages.first_link(links, "html").collect()} == {1: ("/x?a=1&b=2", "ok"), 2: (None, "missing")}
    assert pages.extract_tag_text(df.limit(0), "html", "div").count() == 0
