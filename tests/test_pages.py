from __future__ import annotations

from pyspark.sql import functions as F

from scorebook.sources import pages


def row(cells, cls="ststats"):
    return f'<tr class="{cls}">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def numbered(n, **at):
    cells = [str(i) for i in range(n)]
    for key, value in at.items():
        cells[int(key[1:])] = value
    return cells


def frame(spark, **html):
    return spark.createDataFrame(list(html.items()), "team string, html string")


def test_batter_rows_with_hand(spark):
    html = "<table>" + "".join([
        row(numbered(20, c0="*", c1="<a href='x'>岡 林　</a>", c4="1,234", c6="-")),
        row(numbered(20, c0="+", c1="牧")), row(numbered(20, c0="", c1="京田"), cls="odd ststats"),
        row(numbered(20, c1="計")), row(numbered(19)), row(numbered(20, c1="他"), cls="head"),
    ]) + "</table>"
    got = {r.name: r for r in pages.batters_with_hand(frame(spark, T=html)).collect()}
    assert {n: r.hand for n, r in got.items()} == {"岡林": "左打", "牧": "両打", "京田": "右打"}
    r = got["岡林"]
    assert (r.team, r.ab, r.h, r.doubles, r.triples, r.hr, r.tb, r.sb, r.sf, r.bb, r.hbp) == (
        "T", 1234, 0, 7, 8, 9, 10, 12, 15, 16, 18,
    )


def test_batter_rows_of_the_plain_layout(spark):
    body = "".join([row(numbered(18, c0="*佐 藤")), row(numbered(18, c0="bad", c5="-")), row(numbered(17, c0="short"))])
    html = (
        f'<table class="other"><tbody>{row(numbered(18, c0="no"))}</tbody></table>'
        f'<table class="tablefix2 x"><thead>{row(numbered(18, c0="head"))}</thead><tbody>{body}</tbody></table>'
        f'<table class="tablefix2"><tbody>{row(numbered(18, c0="second"))}</tbody></table>'
    )
    rows = pages.batters_plain(frame(spark, T=html)).collect()
    assert [(r.ab, r.h, r.tb, r.sf, r.bb, r.hbp) for r in rows] == [(3, 5, 9, 14, 15, 17)]


def test_pitcher_counts(spark):
    html = row(numbered(26, c1="東　克", c13="12", c14=".1", c25="-")) + row(numbered(25))
    r = pages.pitcher_counts(frame(spark, DeNA=html)).collect()
    assert [(x.team, x.name, x.g, x.ip, x.h, x.hr, x.so, x.era) for x in r] == [
        ("DeNA", "東克", "2", "12.1", "15", "16", "20", "9.99")
    ]


def pitcher_page(title, pitches="", rates=True, era="2.50", hand="左投"):
    table = "<table><caption>通算成績(各種指標)</caption><tr><th>K/9</th><th>BB/9</th></tr><tr><td>9.1</td><td>2.0</td></tr></table>"
    return (
        f"<html><head><title>{title}</title></head><body><p>{hand}</p>{table if rates else ''}"
        f"<table><tr><th>防御率</th></tr><tr><td>{era}</td></tr></table>"
        f"<table><tr><th>球種</th></tr>{pitches}</table></body></html>"
    )


def test_pitcher_rates_and_pitch_mix(spark):
    mix = row(["ストレート", "1", "55.5%"]) + row(["フォーク", "1", "-"]) + row(["合計", "1", "100%"]) + row(["x", "1"])
    df = frame(
        spark,
        G=pitcher_page("2024 投手成績 18 菅野 智之 - s", mix, era="-"),
        T=pitcher_page("2024 投手成績 19 才木 - s", row(["カーブ", "1", "9%"])),
        C=pitcher_page("2024 打撃成績 1 誰か - s", mix),
        S=pitcher_page("2024 投手成績 20 無 - s", mix, rates=False),
        D=pitcher_page("2024 投手成績 21 欠 - s", mix, era="?"),
        H=pitcher_page("2024 投手成績 22 乱 - s", row(["カーブ", "1", "x%"])),
    )
    got = {r.team: r for r in pages.pitcher_table(df, kinds=["ストレート", "カーブ"]).collect()}
    assert set(got) == {"G", "T"}
    g, t = got["G"], got["T"]
    maps = {r.team: r.shares for r in pages.pitcher_table(df).collect()}
    assert maps == {"G": {"ストレート": 55.5}, "T": {"カーブ": 9.0}}
    assert (g.name, g.hand, g.era, g.k9, g.hr9) == ("菅野 智之", "左投", 9.99, 9.1, 0.0)
    assert (g["pitch_ストレート_share"], g["pitch_カーブ_share"], t["pitch_カーブ_share"]) == (55.5, 0.0, 9.0)
    assert "pitch_フォーク_share" not in g.asDict()


def box_row(name, *results):
    lead = "".join(f"<td>{i}</td>" for i in range(8))
    return f'<tr><td class="left">{name}</td>{lead}' + "".join(f"<td>{r}</td>" for r in results) + "</tr>"


def box_page():
    visitors = "".join(box_row(f"v{i}", "左安" if i == 1 else "……", "&nbsp;", "三振" if i == 2 else "") for i in range(1, 11))
    homers = box_row("h1", "二ゴ") + box_row("h2", "四球") + box_row("h1", "左本") + box_row("計", "9") + "<tr><td class='left'>x</td></tr>"
    score = "".join(
        f'<tr><td class="team">{t}</td><td class="totalScore">{r}</td></tr>' for t, r in (("中日&nbsp;", "０"), ("ＤｅＮＡ", "５"))
    )
    return (
        f'<table class="scoreTable">{score}</table><table class="batter">{visitors}</table>'
        f'<table class="pitcher">{box_row("p", "x")}</table><table class="wide batter">{homers}</table>'
    )


def test_box_score_to_document(spark):
    df = spark.createDataFrame([("https://s/cl2025050101.html", box_page()), ("https://s/none.html", "<p>x</p>")], "url string, html string")
    docs = pages.box_documents(df).collect()
    assert len(docs) == 1
    doc = docs[0].asDict(recursive=True)
    assert doc["scoreboard"] == [{"team": "中日", "R": "０"}, {"team": "ＤｅＮＡ", "R": "５"}]
    live = doc["text_live"]
    assert live[0]["inning"] == "試合前"
    assert [u["players"] for u in live[0]["pregame"]["lineups"]] == [[f"v{i}" for i in range(1, 10)], ["h1", "h2"]]
    plays = [(e["inning"], *e["plays"][0]["lines"]) for e in live[1:]]
    assert plays == [
        ("1回表", "1番 v1", "左安"), ("3回表", "2番 v2", "三振"),
        ("1回裏", "1番 h1", "二ゴ"), ("1回裏", "2番 h2", "四球"), ("1回裏", "2番 h1", "左本"),
    ]


def test_elements_and_attributes(spark):
    df = spark.createDataFrame([(1, '<li class="a" data-x="1">A &amp; B</li><link><li>C</li>')], "page_id int, html string")
    rows = pages.elements(df, "li").withColumn("m", pages.attribute_map(F.col("attributes"))).orderBy("pos").collect()
    assert [(r.pos, r.inner, r.m) for r in rows] == [(0, "A &amp; B", {"class": "a", "data-x": "1"}), (1, "C", {})]


def test_a_row_of_a_box_score_is_read_once(spark):
    df = spark.createDataFrame([("u", box_page())], "url string, html string")
    plan = pages.box_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\bleft\b") == 1 and plan.count("<td(?=") == 1 and plan.count("<tr(?=") == 1
    rows = {(r.side, r.pos): (r.name, len(r.cells)) for r in pages.box_rows(df).collect()}
    assert rows == {(0, i): (f"v{i + 1}", 12) for i in range(10)} | {(1, 0): ("h1", 10), (1, 1): ("h2", 10), (1, 2): ("h1", 10)}
