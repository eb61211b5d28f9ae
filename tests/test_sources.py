"""Files of several layouts, a typed view kept up to date, and landed pages as a stream."""

import time

from pyspark.sql import functions as F

from touchline import catalog, normalise, testbed
from touchline.normalise import refresh_view, refreshed, typed
from touchline.sources import feeds, files
from touchline.streaming import jobs


def test_files_of_several_headers(spark, tmp_path):
    texts = {"a.csv": "﻿match_id,league\n1,SerieA\n2,\n", "b.csv": "league,match_id\nLiga,3\n", "c.csv": '"match_id","league",extra,extra\r\n4,"x, y",5,6\r\n', "d.csv": "", "e.csv": "﻿match_id,league\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    got = files.read_matches_csv(spark, str(tmp_path))
    assert got.columns == ["match_id", "league", "extra", "extra_3"]
    assert sorted(map(tuple, got.collect())) == [("1", "SerieA", None, None), ("2", None, None, None), ("3", "Liga", None, None), ("4", "x, y", "5", "6")]
    (tmp_path / "none").mkdir()
    assert files.read_matches_csv(spark, str(tmp_path / "none")).count() == 0


def test_view_is_refreshed_by_day(spark, sf_dir, tmp_path):
    days = ["1995-01-01", "1995-01-02", "1995-01-03", "1995-01-04"]
    m = testbed.read(spark, sf_dir, "matches").withColumn("owner_date", F.element_at(F.array(*map(F.lit, days), F.lit(None).cast("string")), (F.col("match_id").cast("long") % 5 + 1).cast("int")))
    path = str(tmp_path / "view")
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    stamp = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "view/matches").rglob("*.parquet")}
    assert refresh_view(m, path) == ["", *days]
    assert rows(refreshed(spark, path)) == rows(typed(m))
    assert refresh_view(m, path) == []
    before = stamp()
    changed = m.withColumn("home_score", F.when((F.col("owner_date") == days[1]) & (F.col("match_id").cast("long") % 3 == 0), F.lit("9")).otherwise(F.col("home_score")))
    assert refresh_view(changed, path) == [days[1]]
    after = stamp()
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if days[1] not in str(f)}
    assert rows(refreshed(spark, path)) == rows(typed(changed))
    fewer = changed.where(f"owner_date <> '{days[2]}'")  # a day, and the rows without one, are gone
    assert refresh_view(fewer, path) == ["", days[2]]
    assert rows(refreshed(spark, path)) == rows(typed(fewer))


def test_page_rows_stay_on_the_jvm(spark, sf_dir):
    plan = catalog.queries()["page_matches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_pages(spark):
    html = """<TABLE ID='t1'><tr class=a fid='5'><TH>h&amp;m</TH><td CLASS="x y">a<br>b <a href="q">l1</a><a>l2</a><span class='gray b'>[3]</span></td></tr><tr><td>1.95↑</td></table>
    <table><tr><td>&lt;b&gt; &nbsp; c</td><td></td></tr></table><style>x{}</style><!-- <tr><td>no</td></tr> -->"""
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<p>no table</p>"), (5, "<tr><td>bare")], "page_id long, html string")
    got = [tuple(r) for r in feeds.table_rows(pages).orderBy("id", "row").collect()]
    assert got == [
        (1, 0, "t1", "a", "5", ["h&m", "ab l1l2[3]"], ["", "x y"], [[], ["l1", "l2"]], [[], ["[3]"]]),
        (1, 1, "t1", "", "", ["1.95"], [""], [[]], [[]]),
        (1, 2, "", "", "", ["<b> c", ""], ["", ""], [[], []], [[], []]),
        (5, 0, "", "", "", ["bare"], [""], [[]], [[]]),
    ]
    raw = spark.createDataFrame([(1, b"<meta charset=gbk><tr><td>" + "周六".encode("gbk")), (2, "<tr><td>é".encode()), (3, b"<tr><td>\xff\xfe ok"), (4, "<meta charset='iso-8859-1'><tr><td>é".encode("latin1"))], "page_id long, html binary")
    assert [r["cells"] for r in feeds.table_rows(raw).orderBy("id").collect()] == [["周六"], ["é"], ["�� ok"], ["é"]]


def test_landed_pages_become_matches(spark, tmp_path):
    row = lambda i, score: f'<tr fid="{i}"><td>周六00{i}</td><td>英超</td><td>R1</td><td>12-01 20:00</td><td>{"完" if score else "未"}</td><td><a>H{i}</a></td><td>' + (f"<a>{score}</a><a>半球</a><a>0</a>" if score else "") + f"</td><td><a>A{i}</a></td>{'<td>x</td>' * 6}</tr>"
    page = lambda *rows: ("<html><head><meta charset='gb2312'></head><table>" + "".join(rows) + "</table>").encode("gb18030")
    (tmp_path / "in").mkdir()
    run = lambda: jobs.ingest_pages(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), keep=2).awaitTermination()
    (tmp_path / "in/1.html").write_bytes(page(row(1, ""), row(2, "")))
    run()
    opened = jobs.current(spark, str(tmp_path / "t"))
    for n in range(2, 6):
        time.sleep(0.05)
        (tmp_path / f"in/{n}.html").write_bytes(page(row(1, str(n))))
        run()
        if n == 2:  # a reader of the batch before goes on
            assert sorted((r["match_id"], r["home_score"] or "") for r in opened.collect()) == [("1", ""), ("2", "")]
    got = {r["match_id"]: r for r in jobs.current(spark, str(tmp_path / "t")).collect()}
    assert {k: (r["home_team"], r["home_score"] or "", r["status"]) for k, r in got.items()} == {"1": ("H1", "5", 2), "2": ("H2", "", 0)}
    assert len(list((tmp_path / "t").glob("version=*"))) <= 3


def test_the_typed_view_needs_no_table_of_texts_and_no_whole_stage_code(spark, sf_dir, monkeypatch):
    modes = []
    monkeypatch.setattr(catalog, "_VIEWS", {})
    typed = normalise.typed
    monkeypatch.setattr(normalise, "typed", lambda rows: modes.append(spark.conf.get("spark.sql.codegen.wholeStage")) or typed(rows))
    view = catalog.matches(spark, sf_dir)
    assert [k[2] for k in catalog._VIEWS] == ["typed"] and modes == ["false"] and spark.conf.get("spark.sql.codegen.wholeStage") == "true"
    want = typed(testbed.read(spark, sf_dir, "matches")).select(*view.columns)
    assert view.exceptAll(want).isEmpty() and want.exceptAll(view).isEmpty()
    days = view.groupBy(F.input_file_name()).agg(F.min("owner_date").alias("low"), F.max("owner_date").alias("high")).orderBy("low").collect()
    assert all(a["high"] <= b["low"] for a, b in zip(days, days[1:]))


def test_work_of_a_page_grows_with_its_rows(spark):
    row = "<tr fid='1'>" + "<td>a</td>" * 3 + "</tr>"
    took = []
    for pages, each in ((60, 100), (1, 6000)):  # the same rows on many pages and on one
        df = spark.range(pages).selectExpr("id AS page_id", f"concat('<table id=t>', repeat(\"{row}\", {each}), '</table>') AS html").repartition(1)
        feeds.table_rows(df).write.format("noop").mode("overwrite").save()
        t = time.perf_counter()
        feeds.table_rows(df).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    assert took[1] < 4 * took[0] + 1, took
