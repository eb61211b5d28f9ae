"""Hand-computed rows for the column functions, thresholds from both sides, and deliberate quirks."""

import random

import pytest
from pyspark.sql import functions as F

from touchline import functions as X
from touchline.operators.leagues import league_profile
from touchline.plans import bets, parlay, predict
from touchline.sources import feeds, files, merge
from touchline.streaming import jobs


def ask(spark, column, **values):
    return spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("dialect", "text", "want"),
    [
        ("label", "平手", 0.0), ("label", "受平/半", -0.25), ("label", "两球半", 2.5), ("label", "三球", None), ("label", "-1", 1.0), ("label", "受1.5", -1.5), ("label", "", None), ("label", None, None), ("label", "未知", None),
        ("pattern", "三球", 3.0), ("pattern", "两球半/三", 2.75), ("pattern", "-1", 1.0), ("level", "三球", None), ("strict", "两球半", None), ("strict", "-1", -1.0), ("strict", "两球", 2.0), ("strict", "受一球", -1.0),
        ("hint", "半球", -0.5), ("hint", "受半球", 0.5), ("hint", "-1", -1.0), ("hint", "三/三球半", -3.25), ("hint", "未知", 0.0), ("hint", None, 0.0), ("digits0", "平手", 0.0), ("digits0", "1.25", 1.25), ("digits", "平手", None), ("digits", "-1.5", 1.5),
    ],
)
def test_handicap(spark, dialect, text, want):
    assert ask(spark, X.parse_handicap(F.col("t"), dialect), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("3", 3), (" 3 ", 3), ("3.0", None), ("-", None), ("", None), (None, None), ("+2", 2)])
def test_score(spark, text, want):
    assert ask(spark, X.score_int(F.col("t")), t=text) == want
    assert ask(spark, X.safe_int(F.col("t")), t=text) == (want or 0)


@pytest.mark.parametrize(
    ("h0", "h1", "w0", "w1", "want"),
    [("平手", "平手", "0.90", "0.91", "无变化"), ("平手", "半球", "0.96", "0.90", "升盘降水"), ("半球", "平手", "0.90", "0.95", "降盘升水"), ("平手", "半球", "0.90", "0.91", "升盘"), ("平手", "平手", "0.96", "0.98", "升水"), ("平手", "平手", "0.98", "0.96", "降水"), ("平手", "x", "1", "1", None), ("平手", "平手", "", "1", None)],
)
def test_label(spark, h0, h1, w0, w1, want):
    # 0.98 - 0.96 is a little over 0.02 as a double, so it counts as a change
    assert ask(spark, X.asian_label(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=h0, b=h1, c=w0, d=w1) == want


@pytest.mark.parametrize(("opt", "leg", "match", "want"), [("win", None, None, "won"), ("draw", None, None, "lost"), ("h_draw", "-1", None, "won"), ("h_win", None, "-2", "lost"), ("h_win", None, None, "pending"), ("h_win", "", "-1", "pending"), ("h_win", "x", "-1", "pending"), ("other", None, "1", "pending")])
def test_leg(spark, opt, leg, match, want):
    assert ask(spark, X.leg_result(F.lit(2), F.lit(1), F.col("o"), F.col("l"), F.col("m")), o=opt, l=leg, m=match) == want


def test_settlement_conventions_differ(spark):
    got = spark.range(1).select(*[X.asian_result(F.lit(1), F.lit(1), F.lit("受半球"), c).alias(c) for c in ("pattern", "review", "movement")]).first()
    assert tuple(got) == ("home", "away", "away")
    plate = spark.range(1).select(X.lower_plate(F.lit(2), F.lit(1), F.lit(-1.0)).alias("p")).first()["p"]
    assert (plate["result"], plate["lower_wins"], plate["upper"]) == ("走盘", False, "home")


def test_times(spark):
    assert ask(spark, X.match_number(F.col("t")), t="周日043") == "7043" and ask(spark, X.match_number(F.col("t")), t="第一043") is None
    assert str(ask(spark, X.match_time(F.col("t"), F.lit(2024)), t="02-29 10:30")) == "2024-02-29 10:30:00" and ask(spark, X.match_time(F.col("t")), t="x") is None
    assert [ask(spark, X.match_status(F.col("c"), F.col("t")), c=c, t=t) for c, t in (("4", ""), ("9", "完"), ("9", "改期"), ("9", "推迟"), ("9", "45"), ("3", ""))] == [2, 2, 6, 0, 1, 1]


def test_winner_rules(spark):
    p = lambda *v: tuple(spark.range(1).select(predict.predict_winner(*[F.lit(x).cast("double") for x in v]).alias("p")).first()["p"])
    assert p(1.4, 4, 8, None, None) == ("home", 85.0) and p(1.4, 4, 8, 0.8, 0.2) == ("home", 90.0) and p(1.9, 3.5, 4, 0.1, 0.9) == ("home", 60.0)
    assert p(None, 3, 3, 0.9, 0.1) == ("draw", 50.0) and p(2.5, 3.1, 2.6, None, None) == ("draw", 60.0) and p(2.5, 3.3, 2.5, None, None) == ("draw", 50.0)


def test_feeds(spark):
    raw = spark.createDataFrame([('{"data":{"matches":[{"fid":"1","order":"周一001","status":"4","homescore":"2","awayscore":"0","matchtime":"2025-12-01 03:00:00","ownerdate":"20251130"},{"fid":"2","status":"0","homescore":"0","awayscore":"0"}]}}',), ("no json",)], "value string")
    m = {r["match_id"]: r for r in feeds.parse_match_feed(raw).collect()}
    assert (m["1"]["status"], m["1"]["score"], m["1"]["match_time"], m["1"]["owner_date"]) == (2, "2-0", "12-01 03:00", "2025-11-30") and m["2"]["score"] == "-"
    xml = spark.createDataFrame([('<xml><m matchnum="1001"><row win="1.5" draw="4" lost="6" updatetime="t2"/><row win="1.6" draw="4" lost="5" updatetime="t1"/></m><m matchnum="2"/></xml>',)], "value string")
    got = feeds.parse_odds_feed_xml(xml)
    assert [(r["matchnum"], r["current_win"], r["initial_win"], r["ticks"]) for r in got.collect()] == [("1001", "1.5", "1.6", 2)]
    joined = feeds.join_feeds(feeds.parse_match_feed(raw), got.drop("ticks", "update_time"), got.drop("ticks", "update_time")).collect()
    assert {r["match_id"]: r["hi_current_win"] for r in joined} == {"1": "1.5", "2": None}
    page = spark.createDataFrame([(1, "<table><tr><td> 1.90↑ </td><th>a&amp;b</th></tr><tr></tr></table>"), (2, None)], "page_id long, html string")
    assert [(r["id"], r["row"], r["cells"]) for r in feeds.table_cells(page).collect()] == [(1, 0, ["1.90", "a&b"]), (1, 1, [])]
    both, half = "竞*官*竞*官*(中国)", "竞*官*"
    rows = [("m", 1, "威廉", "-1"), ("m", 2, "**t3*5", "-1"), ("m", 3, both, "-2"), ("m", 4, both, "+1"), ("m", 5, half, "0"), ("n", 1, "x", "-1"), ("n", 2, half, "-1")]
    rows = spark.createDataFrame([(m, p, c, ["", "", v], h) for m, p, c, v in rows for h in ([0.5] if m == "m" else [None])], "match_id string, pos int, company string, cells array<string>, hint double")
    pos = lambda market, r=rows: {x["match_id"]: x["pos"] for x in feeds.preferred_source(r, market).collect()}
    assert pos("euro") == {"m": 3, "n": 1} and pos("asian") == {"m": 2, "n": 1} and pos("ou") == {"m": 1, "n": 1}
    assert pos("index") == {"m": 4} and pos("index", rows.drop("hint")) == {"m": 4} and pos("index", rows.withColumn("hint", F.lit(-1.5))) == {"m": 3}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", 0), ("1", "b", 1), ("2", "c", 2)], "match_id string, league string, position int")
    assert sorted(r["league"] for r in files.first_of_each(df).collect()) == ["a", "c"]
    path = files.write_dataset(df, str(tmp_path), run="r1", form="csv")
    assert files.read_matches_csv(spark, path).count() == 3 and files.read_matches_csv(spark, path).columns == df.columns
    assert (next((tmp_path / "matches/run=r1").glob("part*")).read_bytes()[:3]) == b"\xef\xbb\xbf"
    days = df.withColumn("owner_date", F.concat(F.lit("2024-01-0"), "match_id"))
    daily = files.write_dataset(days, str(tmp_path), kind="days", daily=True)
    assert sorted(x.name for x in (tmp_path / "days/run=run").iterdir() if x.is_dir()) == ["owner_date=2024-01-01", "owner_date=2024-01-02"] and spark.read.parquet(daily).count() == 3
    files.export_matches_json(days, str(tmp_path / "out"), league="b")
    assert [r["match_id"] for r in files.read_many([spark.read.json(str(tmp_path / "out")), df.where("league = 'c'")]).collect()] == ["1", "2"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('[{"match_id": "1", "league": "x"}, {"match_id": "2"}]')
    (tmp_path / "j/b.json").write_text('{"match_id": "3"}')
    assert sorted(r["match_id"] for r in files.read_matches_json(spark, str(tmp_path / "j")).collect()) == ["1", "2"]


LIST_PAGE = """<html><head><meta charset="gb2312"></head><table id="table_match">
<tr fid="77"><td>周六001</td><td>英超</td><td>第3轮</td><td>12-01 20:00</td><td class="td_living">34'</td><td><span class="gray">[07]</span><a>主队</a></td><td><div class="pk"><a>2</a><a>平手</a><a>1</a></div></td><td><a>客队</a><span class="gray">[11]</span></td><td>x</td><td>x</td><td>x</td><td>x</td><td>x</td><td>x</td></tr>
<tr fid="78"><td>英超</td><td>第3轮</td><td>12-01 20:00</td><td>完</td><td><a>甲</a></td><td>1-0</td><td><a>乙</a></td><td>0-0</td><td>x</td><td>x</td></tr><tr><td>no number</td></tr></table></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, bytearray(LIST_PAGE.encode("gb18030"))), (2, None)], "page_id long, html binary")
    got = {r["match_id"]: r for r in feeds.list_page_matches(feeds.table_rows(pages)).collect()}
    assert set(got) == {"77", "78"}
    assert tuple(got["77"][c] for c in ("match_number", "league", "status", "home_team", "away_team", "home_rank", "away_rank", "home_score", "handicap", "away_score")) == ("周六001", "英超", 1, "主队", "客队", "07", "11", "2", "平手", "1")
    assert tuple(got["78"][c] for c in ("match_number", "league", "status", "home_team", "away_team", "home_score")) == ("", "英超", 2, "甲", "乙", "")
    tr = lambda kind, *cells: f'<tr class="{kind}">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    euro = "<table id='datatb'>" + tr("tr1", "1", "威廉", "", *"abcdef") + tr("tr2", "2", "竞*官*竞*官*(中国)", "", "1.5", "3", "5", "1.4↓", "3.1", "6") + "</table>"
    asian = "<table id='datatb'>" + tr("tr1", *"01", "", "0.9↑", "半球", "1.0", *"678", "0.8", "平手", "1.1") + "</table>"
    index = "<table id='datatb'>" + tr("tr1", "1", "竞*官*竞*官*(中国)", "-1", "", *"456", *"789") + tr("tr1", "2", "竞*官*竞*官*(中国)", "+1", "", *"abc", *"def") + "</table>"
    rows = lambda html: feeds.table_rows(spark.createDataFrame([(9, html)], "page_id long, html string"))
    one = lambda html, market, hints=None: [tuple(r) for r in feeds.market_rows(rows(html), market, hints).collect()]
    assert one(euro, "euro") == [(9, "1.5", "3", "5", "1.4", "3.1", "6")]
    assert one(asian, "asian") == [(9, "0.9", "半球", "1.0", "0.8", "平手", "1.1")] and one(asian.replace("0.9", ""), "asian") == []
    hints = spark.createDataFrame([(9, -0.5)], "match_id long, hint double")
    assert one(index, "index")[0][1] == "+1" and one(index, "index", hints)[0][:3] == (9, "-1", "4")
    marks = {"34'": 1, "90+2": 1, "中场": 1, "完": 2, "19:30": 0, "未": 0, "推迟": 0, "xx": 0}
    got = spark.createDataFrame([(k,) for k in marks], "t string").select("t", feeds.page_status(F.col("t"), F.lit("")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == marks


def test_small_functions(spark):
    assert ask(spark, X.stars(F.lit(85)), t="") == "★★★★☆" and ask(spark, X.confidence_mark(F.lit(60)), t="") == 1
    assert ask(spark, X.arrow(F.lit(1.0), F.lit(1.2)), t="") == "↑" and ask(spark, X.arrow(F.lit(1.0), F.lit(1.001)), t="") == "—"
    assert ask(spark, X.strip_arrows(F.col("t")), t=" 1.9↑") == "1.9" and ask(spark, X.clean_rank(F.col("t")), t="[07]") == "07"
    assert ask(spark, bets.option_text(F.split("t", ",")), t="win,h_lose,x") == ["主胜", "让负", "x"]


def test_odds_round_trip(spark, tmp_path):
    """Combined files read back have the three initial groups filled for matches with odds, and '' for the others."""
    from touchline.catalog import _odds_documents

    docs = _odds_documents(spark, "/root/testdata/sf0.001")
    from touchline.testbed import read

    m = read(spark, "/root/testdata/sf0.001", "matches").select("match_id", "league")
    both = merge.combined(m, docs)
    assert len(both.columns) == 29
    back = files.read_matches_csv(spark, files.write_dataset(both, str(tmp_path), kind="combined", form="csv"))
    assert back.columns == both.columns
    text = lambda df: sorted(tuple(x or "" for x in r) for r in df.collect())
    assert text(back) == text(both) and both.where("euro_current_win = '9.99' AND euro_initial_win IS NOT NULL").count() > 0
    # the newest document of a match replaces the older one; one without a market does not
    old = docs.where("odds_update_time = 't9' AND euro_odds IS NOT NULL").limit(2)
    key = old.agg(F.min("match_id")).first()[0]
    newer = old.where(F.col("match_id") == key).withColumns({"seq": F.lit(2).cast("long"), "odds_update_time": F.lit("t2")})
    gone = old.where(F.col("match_id") != key).withColumns({"seq": F.lit(2).cast("long")} | {c: F.lit(None).cast(old.schema[c].dataType) for c in ("euro_odds", "asian_handicap", "over_under", "handicap_index")})
    got = {r["match_id"]: r["odds_update_time"] for r in merge.latest_odds(old, newer.unionByName(gone)).collect()}
    assert sorted(got.values()) == ["t2", "t9"] and got[key] == "t2"


def test_dashboard(spark, sf_dir):
    from touchline import catalog

    legs, m = catalog.view(spark, sf_dir, "legs"), catalog.matches(spark, sf_dir)
    d = bets.bets_dashboard(legs, m, device="d3", limit=5)
    groups = d["groups"].collect()
    assert len(groups) == 5 and d["stats"].count() == 1
    for g in groups:
        assert g["n"] == len(g["bets"]) and ",".join(b["bet_id"] for b in g["bets"]) == g["tickets"]
        for b in g["bets"]:
            assert [i["pos"] for i in b["items"]] == sorted(i["pos"] for i in b["items"]) and all(i["score_text"] for i in b["items"])


def test_typed_view_pushes_filters_down(spark, sf_dir, tmp_path):
    from touchline import catalog
    from touchline.normalise import write_view
    from touchline.operators.results import movement_label_results

    plan = movement_label_results(catalog.matches(spark, sf_dir))._jdf.queryExecution().toString()
    assert "EqualTo(status,2)" in plan
    daily = write_view(catalog.view(spark, sf_dir, "matches").limit(200), str(tmp_path / "daily"), daily=True)
    assert "PartitionFilters: [isnotnull(owner_date" in daily.where("owner_date = '1996-01-02'")._jdf.queryExecution().toString() and daily.count() == 200


def test_shared_folder():
    from types import SimpleNamespace

    from touchline import store

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert store.shared_folder(session("spark://h:1", "hdfs://h/x/")) == "hdfs://h/x"
    with pytest.raises(RuntimeError):
        store.shared_folder(session("local-cluster[2,1,1024]", None))


def test_temporary(spark):
    from touchline import store

    with store.temporary(spark):
        df = store.written(spark.range(5), "x")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert store.exists(spark, path) and df.count() == 5
    assert not store.exists(spark, path)
    wide = spark.range(10).select(F.array_repeat(F.lit(1.0), 1000).alias("v"))
    assert "broadcast" not in store.small_side(wide, 10_000)._jdf.queryExecution().logical().toString().lower() and "broadcast" in store.small_side(wide)._jdf.queryExecution().logical().toString().lower()


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "match_id string, home_team string, away_team string")
    up = spark.createDataFrame([("1", None, "", 1, ["away_team"]), ("1", "", "z", 2, ["home_team", "away_team"]), ("3", "c", "d", 1, ["home_team", "away_team"])], "match_id string, home_team string, away_team string, seq int, present array<string>")
    new = merge.upsert(old, up, ["match_id"])
    assert sorted(map(tuple, new.collect())) == [("1", "", "z"), ("2", "b", "y"), ("3", "c", "d")]
    assert sorted(map(tuple, merge.upsert_matches(old, up.where("seq = 2")).collect())) == sorted(map(tuple, old.collect()))
    assert sorted(map(tuple, merge.upsert(new, up, ["match_id"]).collect())) == sorted(map(tuple, new.collect()))
    assert [r[0] for r in merge.delete(new, old, ["match_id"]).collect()] == ["3"]


def test_a_text_is_one_option(spark):
    rows = [("m1", "d", "win,h_win"), ("m2", "d", "win"), ("m3", "d", "bad"), ("m4", "d", None)]
    got = bets.normalise_picks(spark.createDataFrame([(*r, None) for r in rows], "match_id string, device_id string, options string, confidence string"))
    assert [(r["match_id"], r["manual_options"], r["manual_win_prediction"]) for r in got.collect()] == [("m2", ["win"], "home")]


def test_predictions_again_keep_manual_picks(spark):
    old = spark.createDataFrame([("1", "home", "draw", True, 50.0), ("2", "away", None, True, 25.0)], "match_id string, win_prediction string, manual_win_prediction string, is_reviewed boolean, accuracy double")
    new = spark.createDataFrame([("1", "away", 1), ("3", None, 1)], "match_id string, win_prediction string, other int")
    assert sorted(map(str, map(tuple, predict.upsert_predictions(old, new).collect()))) == [str(x) for x in (("1", "away", "draw", False, 50.0), ("2", "away", None, True, 25.0), ("3", None, None, False, None))]


def test_best_pair_is_brute_force(spark):
    import itertools

    c = [(f"m{i // 2:02d}", f"0{i % 7}-01 10:00" if i % 11 else None, i % 3, round(1.5 + (i * 37 % 25) / 100, 2)) for i in range(60)]
    df = spark.createDataFrame(c, "match_id string, match_time string, k int, odds double")
    listed = sorted(c, key=lambda x: (x[1] is not None, x[1] or "", x[0], -x[2]), reverse=True)  # newest first, missing times last
    both = [(abs(round(a[3] * 100) * round(b[3] * 100) - 30000), i) for i, (a, b) in enumerate(itertools.combinations(listed, 2)) if a[0] != b[0]]
    pairs = list(itertools.combinations(listed, 2))
    want = [pairs[i] for _, i in sorted(both)[:4]]
    assert [(r["match_1"], r["k_1"], r["match_2"], r["k_2"]) for r in parlay.best_pair(df, 3.0, top=4).collect()] == [(a[0], a[2], b[0], b[2]) for a, b in want]
    assert parlay.best_pair(df.limit(0)).count() == 0


@pytest.mark.parametrize("places,n,target", [(3, 2, 3.2), (3, 3, 5.0), (3, 5, 9.0), (5, 4, 8.0), (6, 2, 3.0)])
def test_combinations_of_any_odds(spark, places, n, target):
    """Odds of three and more places, among them 1.925, with matches that hold several candidates; held against all combinations."""
    import itertools
    import math

    rnd = random.Random(places * 10 + n)
    odds = [1.925, *(round(rnd.uniform(1.5, 2.0), places) for _ in range(13))]
    c = [(o, f"m{i % 9}", f"0{i % 3}-02 10:00", i // 9) for i, o in enumerate([*odds, odds[3]])] + [(0.0, "m1", None, 2), (None, "m2", None, 2)]
    df = spark.createDataFrame(c, "odds double, match_id string, match_time string, k int")
    listed = sorted((x for x in c if x[0]), key=lambda x: (x[2], x[1], -x[3]), reverse=True)
    whole = lambda x: round(x[0] * 10**6)
    fits = [x for x in itertools.combinations(listed, n) if len({v[1] for v in x}) == n]
    best = min(fits, key=lambda x: abs(math.prod(map(whole, x)) - round(target * 10**6) * 10 ** (6 * (n - 1))))
    got = parlay.n_fold(df, n, target).collect()
    assert [tuple(r)[: 2 * n] for r in got] == [tuple(y for v in best for y in (v[1], v[3]))]
    assert [got[0][f"odds_{i + 1}"] for i in range(n)] == [v[0] for v in best]
    if n == 2:
        assert tuple(parlay.best_pair(df, target).collect()[0])[:4] == tuple(got[0])[:4]
        inside = [x for x in fits if 2.6 <= x[0][0] * x[1][0] <= 2.9]
        best = min(inside, key=lambda x: abs(whole(x[0]) * whole(x[1]) - round(target * 10**12)))
        assert tuple(parlay.best_pair(df, target, 2.6, 2.9).collect()[0])[:4] == tuple(y for v in best for y in (v[1], v[3]))


def test_stream_is_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.odds_trend(jobs.ticks(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("trend").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("trend").collect())) == sorted(map(tuple, jobs.odds_trend(jobs.ticks(events)).collect()))


def test_ingest(spark, tmp_path):
    schema = "match_id string, home_team string, away_team string, home_score string, seq long, present array<string>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"match_id":"1","home_team":"a","away_team":"b","home_score":"","seq":1,"present":["home_team","away_team","home_score"]}\n{"match_id":"2","home_team":"","away_team":"b","seq":1,"present":["home_team","away_team"]}\n')
    jobs.ingest_snapshots(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/2.json").write_text('{"match_id":"1","home_score":"2","seq":2,"present":["home_score"]}\n')
    jobs.ingest_snapshots(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in jobs.current(spark, str(tmp_path / "t")).collect()] == [("1", "a", "b", "2")]


def test_ingest_with_odds(spark, tmp_path):
    """Odds documents that come with snapshots fill the match columns; a file that lands twice changes nothing; other buckets keep their version."""
    market = lambda *p: f"array<struct<{', '.join(f'{w}_{x}: string' for w in ('initial', 'current') for x in p)}>>"
    schema = f"match_id string, home_team string, away_team string, seq long, present array<string>, euro_odds {market('win', 'draw', 'lose')}, asian_handicap {market('home_odds', 'handicap', 'away_odds')}, over_under {market('over_odds', 'total', 'under_odds')}, handicap_index struct<handicap_value: string, {', '.join(f'{w}_{x}: string' for w in ('initial', 'current') for x in ('home_odds', 'draw_odds', 'away_odds'))}>, euro_odds_update_time string, odds_update_time string"
    (tmp_path / "in").mkdir()
    names = '"present":["home_team","away_team"]'
    first = "".join(f'{{"match_id":"{i}","home_team":"a{i}","away_team":"b","seq":1,{names},"euro_odds":[{{"current_win":"1.{i}"}}]}}\n' for i in range(9))
    run = lambda: jobs.ingest_snapshots(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    for name, text in (("1", first), ("2", f'{{"match_id":"3","home_team":"a3","away_team":"b","seq":2,{names},"handicap_index":{{"handicap_value":"-1"}}}}\n'), ("3", first)):
        (tmp_path / f"in/{name}.json").write_text(text)
        run()
    got = {r["match_id"]: r for r in jobs.current(spark, str(tmp_path / "t")).collect()}
    assert len(got) == 9 and all(got[str(i)]["euro_current_win"] == f"1.{i}" for i in range(9)) and got["3"]["hi_handicap_value"] == "-1" and got["4"]["hi_handicap_value"] is None


def test_alert_stream_and_runs(spark, sf_dir, tmp_path):
    from touchline import testbed
    from touchline.normalise import typed

    m = testbed.read(spark, sf_dir, "matches")
    seen = m.withColumn("seen_at", F.expr("timestamp'2024-05-01 10:00:00'"))
    for _ in range(2):  # the same snapshots twice: each alert once
        seen.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema)
        jobs.stream_alerts(spark, str(tmp_path / "in"), schema, str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "alerts")), jobs.live_alerts(m)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    p = testbed.read(spark, sf_dir, "predictions")
    m.coalesce(1).write.json(str(tmp_path / "run"))
    jobs.predict_and_review_run(spark, str(tmp_path / "run"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema), p, m, str(tmp_path / "t"), str(tmp_path / "cp2")).awaitTermination()
    for name, batch in (("reviews", predict.review_predictions(typed(m), p)), ("predictions", predict.predict_upcoming(typed(m)))):
        rows = spark.read.parquet(str(tmp_path / f"t/{name}"))
        assert sorted(map(str, rows.select(*batch.columns).collect())) == sorted(map(str, batch.collect())), name


def test_hourly_and_daily_streams_are_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    for name in ("odds_trend_by_hour", "odds_trend_by_day"):
        stream = getattr(jobs, name)(jobs.ticks(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), late="1 hour")
        q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, getattr(jobs, name)(jobs.ticks(events)).collect()))


def test_profile_minimum(spark, sf_dir):
    from touchline.catalog import matches

    assert league_profile(matches(spark, sf_dir), least=10**9).count() == 0


@pytest.mark.parametrize("n,target,matches", [(2, 3.0, 12), (3, 5.0, 7), (4, 8.0, 5), (5, 9.0, 6), (3, 5.0, 2)])
def test_n_fold_is_brute_force(spark, n, target, matches):
    import itertools
    import math

    c = [(round(1.5 + (i * 17 % 9) / 20, 2), f"m{i % matches}", f"0{i % 3}-02 10:00", i // matches) for i in range(2 * matches)]
    got = [tuple(r) for r in parlay.n_fold(spark.createDataFrame(c, "odds double, match_id string, match_time string, k int"), n, target).collect()]
    listed = sorted(c, key=lambda x: (x[2], x[1], -x[3]), reverse=True)
    off = lambda x: abs(math.prod(round(v[0] * 100) for v in x) - round(target * 100) * 100 ** (n - 1))
    fits = [x for x in itertools.combinations(listed, n) if len({v[1] for v in x}) == n]
    best = min(fits, key=off, default=None)  # the first of the nearest
    if best is None:
        assert got == []
    else:
        assert got[0][: 2 * n] == tuple(y for v in best for y in (v[1], v[3]))
        assert got[0][-1] == pytest.approx(off(best) / 100**n, abs=1e-12)


def test_banker_pair(spark):
    c = spark.createDataFrame([("a", 1, 1.3), ("a", 3, 1.85), ("b", 3, 1.85)], "match_id string, k int, odds double")
    assert [tuple(r)[:5] for r in parlay.banker_pair(c).collect()] == [("a", 1, 1.3, "a", 3)]
    assert [tuple(r)[:5] for r in parlay.banker_pair(c, apart=True).collect()] == [("a", 1, 1.3, "b", 3)]
    assert parlay.banker_pair(c.limit(1)).count() == parlay.banker_pair(c.where("match_id = 'a'"), apart=True).count() == 0


def test_place_bets(spark):
    t = [("s1", "d", [(["x", "y"], "two", 3.0, 4.0, 1), (["x"], "one", 2.0, 2.0, 1)]), ("s2", "", [(["x"], "", 1.0, 1.0, 1)]), ("s3", "d", None)]
    df = spark.createDataFrame(t, "submission_id string, device_id string, tickets array<struct<combo: array<string>, desc: string, odds: double, stake: double, multiple: int>>")
    got = bets.place_bets(df.selectExpr("*", "timestamp'2024-01-01' AS created_at")).collect()
    assert [(r["bet_id"], r["group_id"], r["type"], r["status"]) for r in got] == [("s1-0", "s1", "parlay", "pending"), ("s1-1", "s1", "single", "pending")]


def test_settle_on_result(spark, sf_dir, tmp_path):
    """After all results have come in, in two files, the bets stand as a batch run over the final matches has them."""
    from touchline import testbed
    from touchline.normalise import typed

    final, legs = testbed.read(spark, sf_dir, "matches"), testbed.read(spark, sf_dir, "legs").where("old_status = 'pending'")
    k = F.col("match_id").cast("long")
    before = final.withColumn("status", F.when(k % 4 == 0, 0).otherwise(F.col("status")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in final.schema)
    args = (spark, str(tmp_path / "in"), schema, legs, before, str(tmp_path / "t"), str(tmp_path / "cp"))
    for rest in (0, 4):
        final.where(k % 8 == rest).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        jobs.settle_on_result(*args).awaitTermination()
    want = bets.settle_bets(legs, typed(final)).where("status <> 'pending'")
    touched = legs.where(F.col("mid").cast("long") % 4 == 0).join(final, F.col("mid") == F.col("match_id"), "left_semi").select("bet_id").distinct()
    got = jobs.settled(spark, str(tmp_path / "t"))
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.join(touched, "bet_id", "left_semi").select(*got.columns).collect()))
