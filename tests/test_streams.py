"""Streams against their batch forms, with bounded state, and tables kept up to date batch by batch."""

import json

import pytest
from pyspark.sql import functions as F

from touchline import testbed
from touchline.normalise import typed
from touchline.operators import teams
from touchline.plans import bets, predict
from touchline.sources import feeds
from touchline.store import exists
from touchline.streaming import form_table, jobs, versions


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def drained(stream, tmp_path, name):
    """Runs a streaming frame in append mode over all that has landed."""
    return stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()


def run(make, tmp_path, name):
    q = drained(make(), tmp_path, name)
    q.awaitTermination()
    return q


def test_trend_of_feed_documents_as_a_stream(spark, tmp_path):
    """XML documents land one by one: a match's run comes out once it is quiet, its state goes, and late ticks change nothing."""
    def doc(name, *ticks):
        rows = "".join(f'<row win="{v}" draw="3" lost="4" updatetime="{t}"/>' for t, v in ticks)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{name}.xml").write_text(f'<xml><m matchnum="{name[0]}001">{rows}</m></xml>')

    def make():
        raw = spark.readStream.schema("value string").text(str(tmp_path / "in"), wholetext=True)
        return jobs.odds_trend_by_match(jobs.feed_ticks(feeds.odds_ticks(raw)), quiet="2 hours", late="30 minutes")

    doc("1a", ("2024-01-01 11:00:00", "1.9"), ("2024-01-01 10:00:00", "2.0"))
    run(make, tmp_path, "out")
    doc("1b", ("2024-01-01 12:00:00", "1.8"))
    run(make, tmp_path, "out")
    doc("2a", ("2024-01-02 09:00:00", "3.0"))
    run(make, tmp_path, "out")
    doc("1c", ("2024-01-01 10:30:00", "9.9"))  # late: the run has ended
    doc("2b", ("2024-01-03 09:00:00", "3.5"))
    q = run(make, tmp_path, "out")
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
    got = spark.read.parquet(str(tmp_path / "out"))
    kept = spark.read.text(str(tmp_path / "in"), wholetext=True).where("NOT contains(value, '9.9')")
    want = jobs.odds_trend_by_match(jobs.feed_ticks(feeds.odds_ticks(kept)), quiet="2 hours")
    assert rows(got) == rows(want.where("opened < '2024-01-03'"))
    assert ("2024-01-01 10:00:00", "1001", "euro", 3, 2.0, 1.8) == tuple(got.where("match_id = '1001'").first())[:6]


def test_settlement_as_a_join_of_streams(spark, tmp_path):
    """Legs and results land apart and out of order; bets come out as ``settle_bets`` has them, those without a result in time as pending."""
    ts = "2024-01-{:02d} {:02d}:00:00".format
    legs, results, m = [], [], []
    for i in range(40):
        day = 1 + i // 8
        for pos in range(1 + i % 3):
            mid = f"m{(i * 3 + pos * 5) % 24 + 24 * (day - 1)}"
            legs.append({"bet_id": f"b{i}", "pos": pos, "mid": mid, "opt": ["win", "draw", "lose", "h_win"][(i + pos) % 4], "leg_odds": 1.5 + pos / 4, "leg_handicap": "-1" if pos else None, "group_id": None, "device_id": f"d{i % 3}", "created_at": ts(day, 8), "stake": 10.0, "old_status": "pending", "descr": "x", "closes_at": ts(day, 20)})
    for k in range(24 * 5):
        h, a = k % 3, k // 3 % 3
        if k % 11:  # others never end in time
            results.append({"match_id": f"m{k}", "h": h, "a": a, "hi_handicap_value": "+1", "ended_at": ts(1 + k // 24, 20 + k % 3)})
        m.append((f"m{k}", 2 if k % 11 else 0, h, a, "+1"))
    end = [{**legs[0], "bet_id": "last", "mid": "none", "closes_at": ts(28, 0)}], [{**results[0], "match_id": "none2", "ended_at": ts(28, 0)}]
    kinds = {"legs": "bet_id string, pos int, mid string, opt string, leg_odds double, leg_handicap string, group_id string, device_id string, created_at timestamp, stake double, old_status string, descr string, closes_at timestamp", "results": "match_id string, h int, a int, hi_handicap_value string, ended_at timestamp"}
    for k in kinds:
        (tmp_path / k).mkdir()
    put = lambda k, name, items: (tmp_path / k / f"{name}.json").write_text("".join(json.dumps(x) + "\n" for x in items))
    make = lambda: jobs.settle_in_time(*[spark.readStream.schema(kinds[k]).json(str(tmp_path / k)) for k in kinds], span="3 days", after="4 hours", late="1 hour")
    for n, days in enumerate(((1, 2), (3, 4, 5))):
        put("results", f"r{n}", [x for x in results if int(x["ended_at"][8:10]) in days])
        put("legs", f"l{n}", [x for x in legs if int(x["closes_at"][8:10]) in days])
        run(make, tmp_path, "out")
    for n in range(2):  # the clock goes on, which lets the last bets out
        put("legs", f"end{n}", [{**x, "bet_id": f"last{n}"} for x in end[0]])
        put("results", f"end{n}", [{**x, "match_id": f"none{n}"} for x in end[1]])
        q = run(make, tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out"))
    frame = spark.createDataFrame([tuple(x.values()) for x in legs], kinds["legs"].replace("timestamp", "string"))
    want = bets.settle_bets(frame.withColumn("created_at", F.to_timestamp("created_at")), spark.createDataFrame(m, "match_id string, status int, h int, a int, hi_handicap_value string"))
    assert rows(got.select(want.columns)) == rows(want) and {"won", "lost", "pending"} == {r["status"] for r in got.collect()}
    assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) <= 10  # only what came for the last day


def test_form_table_is_the_form_of_the_union(spark, sf_dir, tmp_path):
    m = typed(testbed.read(spark, sf_dir, "matches")).cache()
    key = F.pmod(F.xxhash64("match_id"), F.lit(4))
    table = str(tmp_path / "form")
    for epoch, k in ((0, 2), (1, 0), (2, 3), (3, 1), (3, 1)):  # the last one twice
        form_table.update(spark, table, m.where(key == k), epoch)
    form_table.update(spark, table, m.limit(0), 10)
    assert rows(form_table.form(spark, table)) == rows(teams.team_form(m))
    # corrections: some matches are taken back, some get another score
    taken = m.where("match_id % 40 = 0").withColumn("status", F.lit(0))
    other = m.where("match_id % 40 = 8").withColumns({"home_score": F.lit("7"), "away_score": F.lit("0")})
    form_table.update(spark, table, typed(taken.unionByName(other).select(testbed.read(spark, sf_dir, "matches").columns)), 11)
    after = m.where("match_id % 40 NOT IN (0, 8)").unionByName(typed(taken.unionByName(other).select(testbed.read(spark, sf_dir, "matches").columns)))
    assert rows(form_table.form(spark, table)) == rows(teams.team_form(after))
    some = spark.createDataFrame([("T1",), ("nobody",)], "team string")
    assert rows(form_table.form(spark, table, some)) == rows(teams.team_form(after).where("team = 'T1'"))


def test_a_batch_touches_the_buckets_of_its_teams_only(spark, sf_dir, tmp_path):
    m = typed(testbed.read(spark, sf_dir, "matches")).cache()
    table = str(tmp_path / "form")
    form_table.update(spark, table, m, 0)
    one = m.where("status = 2").limit(1)
    form_table.update(spark, table, one, 1)
    assert spark.read.parquet(f"{table}/version=1").select("bucket").distinct().count() <= 2


def test_versions_are_retired_and_open_readers_go_on(spark, tmp_path):
    table = str(tmp_path / "t")
    frame = lambda v, ids: spark.createDataFrame([(str(i), v) for i in ids], "match_id string, v int")
    bucket = {i: r[0] for i in range(30) for r in [spark.range(1).select(versions.bucket_of(F.lit(str(i)))).first()]}
    versions.put(spark, table, frame(0, range(30)), 0, sorted(set(bucket.values())))
    state = dict.fromkeys(range(30), 0)
    readers = []
    for epoch in range(1, 7):
        touched = bucket[epoch]
        ids = [i for i in range(30) if bucket[i] == touched]
        versions.put(spark, table, frame(epoch, ids), epoch, [touched])
        state |= dict.fromkeys(ids, epoch)
        readers.append((versions.current(spark, table), dict(state)))
        versions.retire(spark, table, keep=3)
        assert {int(r["match_id"]): r["v"] for r in versions.current(spark, table).collect()} == state
    for opened, then in readers[-3:]:
        assert {int(r["match_id"]): r["v"] for r in opened.collect()} == then
    # one bucket rewritten again and again: its older versions go
    for epoch in range(7, 12):
        versions.put(spark, table, frame(epoch, [i for i in range(30) if bucket[i] == bucket[1]]), epoch, [bucket[1]])
        versions.retire(spark, table, keep=2)
    assert not exists(spark, f"{table}/version=8") and not exists(spark, f"{table}/version=1") and exists(spark, f"{table}/version=10")
    assert spark.read.parquet(f"{table}/done").count() < 12
    assert {r["v"] for r in versions.current(spark, table).where(f"match_id = '1'").collect()} == {11}


def test_backtest_looks_at_nothing_from_kick_off_on(spark, sf_dir):
    raw = testbed.read(spark, sf_dir, "matches")
    day = "1995-06-30"
    changed = raw.withColumns({c: F.when((F.col("owner_date") > day) & (F.col("status") == 2), F.lit("6" if c == "home_score" else "0")).otherwise(F.col(c)) for c in ("home_score", "away_score")})
    both = [predict.predict_before(typed(x)).join(raw.where(f"owner_date <= '{day}'").select("match_id"), "match_id", "left_semi") for x in (raw, changed)]
    assert both[0].count() > 0 and rows(both[0]) == rows(both[1])
    first = predict.with_form_before(typed(raw)).where("home_matches IS NULL")
    assert first.count() > 0


def test_kick_offs_at_the_same_time_see_none_of_one_another(spark):
    schema = ", ".join(f"{c} string" for c in ("match_id", "league", "home_team", "away_team", "home_score", "away_score", "owner_date", "match_time"))
    base = testbed.match_columns("spark")
    m = [("1", "L", "A", "B", "1", "0", "2024-01-01", "01-01 10:00"), ("2", "L", "A", "C", "1", "0", "2024-01-02", "01-02 10:00"), ("3", "L", "A", "D", "1", "0", "2024-01-02", "01-02 10:00"), ("4", "L", "E", "A", "2", "0", "2024-01-02", "01-02 11:00")]
    df = spark.createDataFrame(m, schema).withColumn("status", F.lit(2))
    df = df.withColumns({c: F.lit(None).cast("string") for c in base if c not in df.columns})
    got = {(r["match_id"], r["team"]): (r["matches"], r["wins"], r["goals_for"]) for r in teams.form_before(typed(df)).collect()}
    assert got["2", "A"] == got["3", "A"] == (1, 1, 1) and got["4", "A"] == (3, 3, 3) and got["1", "A"] == got["4", "E"] == (0, 0, 0)


@pytest.mark.parametrize("seen, want", [("2024-01-08 20:00:00", "a"), ("2024-01-09 10:00:00", "a"), ("2024-01-09 12:00:00", None), ("2024-01-03 12:00:00", "a"), ("2024-01-01 20:00:00", "b")])
def test_feed_snapshots_by_day(spark, seen, want):
    """Monday's number 001 of two weeks: a snapshot belongs to the next Monday that is not over."""
    m = spark.createDataFrame([("a", "周一001", "2024-01-08"), ("b", "周一001", "2024-01-01"), ("c", "x", "2024-01-08"), ("d", None, None)], "match_id string, match_number string, owner_date string")
    feed = spark.createDataFrame([("1001", seen, "1.5"), ("1001", "2023-12-25 20:00:00", "9.9"), ("x", seen, "2")], "matchnum string, seen_at string, win string").withColumn("seen_at", F.to_timestamp("seen_at"))
    got = feeds.join_feeds_by_day(m, feed, feed.limit(0)).collect()
    assert len(got) == 4 and {r["match_id"] for r in got if r["hi_win"] == "1.5"} == ({want} if want else set())
