"""Snapshot ingestion, live alerts and odds trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import first_present, leg_result
from ..normalise import typed
from ..plans.bets import settle_bets, tickets
from ..plans.predict import predict_upcoming, review_predictions
from ..sources.feeds import list_page_matches, table_rows
from ..sources.merge import flatten_odds, upsert_matches, upsert_odds
from ..store import exists, written
from . import form_table
from .versions import bucket_of, current, put, retire

__all__ = ["current", "retire"]


def ticks(events: DataFrame) -> DataFrame:
    """Odds ticks of event rows: match, market, time, order and value. The time becomes a TIMESTAMP, as watermarks need."""
    return events.select(F.col("user_id").alias("match_id"), F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), "value")


def odds_trend(t: DataFrame, late: str | None = None) -> DataFrame:
    """Initial and current value, number and change of the ticks of each match and market; ``late`` is the watermark of a stream.

    Of a stream the state of a match and market would never go; ``odds_trend_by_day`` is the form whose state is bounded.
    """
    t = t if late is None else t.withWatermark("ts", late)
    return _trend(t, "match_id", "market").withColumn("change", F.col("current") - F.col("initial"))


def _trend(t: DataFrame, *keys) -> DataFrame:
    at = F.struct("ts", "tick_id")
    return t.groupBy(*keys).agg(F.count("*").alias("ticks"), F.min_by("value", at).alias("initial"), F.max_by("value", at).alias("current"))


def odds_trend_by_day(t: DataFrame, late: str | None = None) -> DataFrame:
    """The same within days of UTC: a day's state is dropped once the watermark has passed it, so a stream holds the open days only."""
    t = t if late is None else t.withWatermark("ts", late)
    g = _trend(t, F.window("ts", "1 day").alias("w"), "match_id", "market")
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "match_id", "market", "ticks", "initial", "current", (F.col("current") - F.col("initial")).alias("change"))


def odds_trend_by_hour(t: DataFrame, late: str | None = None) -> DataFrame:
    """The same within tumbling hours of each market."""
    t = t if late is None else t.withWatermark("ts", late)
    at = F.struct("ts", "tick_id")
    g = t.groupBy(F.window("ts", "1 hour").alias("w"), "market").agg(F.count("*").alias("ticks"), F.min_by("value", at).alias("initial"), F.max_by("value", at).alias("current"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "market", "ticks", "initial", "current")


def odds_trend_by_match(t: DataFrame, quiet: str = "6 hours", late: str | None = None) -> DataFrame:
    """The trend of each run of ticks of a match and market, which ends when none has come for ``quiet``: one row for each run.

    On a stream (``late`` is its watermark, append mode) a run's state is three values; it is dropped, and its row comes out,
    once the watermark has passed its end. A tick later than that changes nothing, as the watermark drops it.
    """
    t = t if late is None else t.withWatermark("ts", late)
    g = _trend(t, F.session_window("ts", quiet).alias("w"), "match_id", "market")
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("opened"), "match_id", "market", "ticks", "initial", "current", (F.col("current") - F.col("initial")).alias("change"))


def feed_ticks(rows: DataFrame, market: str = "euro", value: str = "win") -> DataFrame:
    """The rows of ``sources.feeds.odds_ticks`` as ticks: within a document the last row is the oldest."""
    return rows.select(F.col("matchnum").alias("match_id"), F.lit(market).alias("market"), F.try_to_timestamp("update_time").alias("ts"), (-F.col("pos")).cast("long").alias("tick_id"), F.col(value).try_cast("double").alias("value"))


def live_alerts(m: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Live matches with draw odds of 2.85 to 3.5, current or else initial, or a level handicap line; a stateless filter, the same on a stream.

    ``alert`` is the text of the notification: number, time of day, teams, and the tags that apply. ``more`` names columns to keep.
    """
    line = F.trim(F.coalesce("hi_handicap_value", F.lit("")))
    draw = first_present(F.col("euro_current_draw"), F.col("euro_initial_draw")).try_cast("double")
    level = line.isin("0", "平手") | F.contains(line, F.lit("平"))
    hit = F.coalesce(draw.between(2.85, 3.5), F.lit(False))
    time = F.when(F.length("match_time") >= 5, F.right("match_time", F.lit(5))).otherwise(F.coalesce("match_time", F.lit("")))
    head = F.concat_ws(" ", F.coalesce("match_number", F.lit("")), time, "home_team", F.lit("vs"), "away_team")
    tags = F.concat_ws(" ", F.when(hit, F.concat(F.lit("平"), draw.cast("string"))), F.when(level, F.lit("让平")))
    return m.where("status = 1").where(hit | level).select("match_id", "league", "home_team", "away_team", draw.alias("draw_odds"), hit.alias("by_draw"), level.alias("by_line"), F.concat(head, F.lit(" ["), tags, F.lit("]")).alias("alert"), *more)


def stream_alerts(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, late: str = "1 day"):
    """Starts a run over landed match snapshots (with ``seen_at``) that appends each match's alert once to the Parquet table.

    A match is remembered until the watermark is ``late`` past its first alert, which bounds the state.
    """
    stream = spark.readStream.schema(schema).json(source).withWatermark("seen_at", late)
    alerts = live_alerts(stream, ("seen_at",)).dropDuplicatesWithinWatermark(["match_id"])
    return alerts.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_snapshots(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keep: int | None = None):
    """Starts a run over landed snapshot files that merges each batch into the Parquet table below ``table``.

    An update row has match columns, ``seq`` and ``present``; it may also carry the nested odds columns of ``flatten_odds``.
    A file that lands twice changes nothing, as updates go by ``seq``. The table is cut into buckets by match; a batch writes
    the buckets of its matches only, each as a new version, and then one row that says which version of which bucket counts,
    so a failed or repeated batch leaves the table as it was. ``keep``: versions that no reader of the last ``keep`` batches can
    reach are removed after each. Returns the query; with ``availableNow`` it ends when the landed
    files are done.
    """

    stream = spark.readStream.schema(schema).json(source)
    merge = lambda batch, epoch: _merge(batch, epoch, table, keep)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_pages(spark: SparkSession, source: str, table: str, checkpoint: str, keep: int | None = 3):
    """Starts a run over landed list pages, files of HTML bytes, that merges their matches into the table as ``ingest_snapshots`` does.

    A page's columns count from the time that its file was written; names and times that a page leaves empty change nothing.
    """
    def merge(pages: DataFrame, epoch: int) -> None:
        p = pages.select(F.xxhash64("path").alias("page_id"), F.col("content").alias("html"), F.unix_micros(F.col("modificationTime").cast("timestamp")).alias("seq"))
        m = list_page_matches(table_rows(p)).join(p.select(F.col("page_id").alias("id"), "seq"), "id")
        columns = [c for c in m.columns if c not in ("id", "row", "seq")]
        said = F.array_compact(F.array(*[F.when(F.col(c).cast("string") != "", F.lit(c)) for c in columns]))
        _merge(m.withColumn("present", said).select(*columns, "seq", "present"), epoch, table, keep)

    stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merge(batch: DataFrame, epoch: int, table: str, keep: int | None) -> None:
    session = batch.sparkSession
    batch = written(batch.dropDuplicates(["match_id", "seq"]).withColumn("bucket", bucket_of()), "batch")
    touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most BUCKETS
    plain = [c for c in batch.columns if c not in ("seq", "present", "bucket", *ODDS_COLUMNS)]
    known = current(session, table, before=epoch, buckets=touched)
    empty = batch.select(*plain).limit(0)
    if set(ODDS_COLUMNS) <= set(batch.columns):
        flat = flatten_odds(batch)
        empty = empty.withColumns({c: F.lit(None).cast(t) for c, t in flat.dtypes if c not in (*plain, "seq", "present")})
    old = known if known is not None else empty
    new = upsert_matches(old, batch.select(*[F.col(c) if c in plain else F.lit(None).cast(t).alias(c) for c, t in old.dtypes], "seq", "present"))
    if set(ODDS_COLUMNS) <= set(batch.columns):
        new = upsert_odds(new, batch)
    if new.isEmpty():
        return
    put(session, table, new, epoch, touched)
    if keep is not None:
        retire(session, table, keep)


ODDS_COLUMNS = ("euro_odds", "asian_handicap", "over_under", "handicap_index", "euro_odds_update_time", "odds_update_time")


def predict_and_review_run(spark: SparkSession, source: str, schema: str, predictions: DataFrame, history: DataFrame, table: str, checkpoint: str):
    """Starts a run over landed match snapshots: each batch reviews the predictions of its finished matches against them and predicts its open ones.

    ``history`` are the raw matches that forms begin with; they are read once, for the first run. From then on a table of the
    newest matches of each team below ``table`` goes along: a batch merges its finished matches and reads the form of its own
    teams, so its work does not grow with the history. Rows go below ``table``, a folder a batch, which a repeated batch replaces.
    """
    forms = f"{table}/form"
    if not exists(spark, f"{forms}/done"):
        form_table.update(spark, forms, written(typed(history), "history"), -1)

    def run(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        m = written(typed(batch), "batch")
        form_table.update(session, forms, m, epoch)
        retire(session, forms)
        teams = written(m.where("status = 0").select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct(), "teams")
        mine = predictions.join(m.select("match_id").distinct(), "match_id", "left_semi")
        at = F.lit(epoch).cast("long")
        review_predictions(m, mine).withColumn("batch_id", at).write.mode("overwrite").parquet(f"{table}/reviews/batch={epoch}")
        predict_upcoming(m, form_table.form(session, forms, teams, upto=epoch)).withColumn("batch_id", at).write.mode("overwrite").parquet(f"{table}/predictions/batch={epoch}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle_in_time(legs: DataFrame, results: DataFrame, span: str = "3 days", after: str = "4 hours", late: str | None = None) -> DataFrame:
    """Bets settled by joining their legs with the results of their matches: the batch form and, with ``late``, a join of two streams.

    A leg row says when the last match of its bet kicks off (``closes_at``), a result row (match_id, h, a, hi_handicap_value,
    ended_at) comes once for each finished match. A result counts for a bet if its match ended within ``span`` before that
    kick-off and ``after`` it. Legs wait in the state until then; a leg whose result has not come by that time is pending, and
    so is its bet. A bet comes out once, when the watermark (``late``, append mode) has passed its time, and its state goes; no
    update that came before is read again. All legs of a bet have the same ``closes_at``.
    """
    if late is not None:
        legs, results = legs.withWatermark("closes_at", late), results.withWatermark("ended_at", late)
    r = results.select(F.col("match_id").alias("result_of"), "h", "a", "hi_handicap_value", "ended_at")
    in_time = F.col("ended_at").between(F.col("closes_at") - F.expr(f"INTERVAL {span}"), F.col("closes_at") + F.expr(f"INTERVAL {after}"))
    j = legs.join(r, (F.col("mid") == F.col("result_of")) & in_time, "left_outer")
    state = F.when(F.col("result_of").isNotNull(), leg_result(F.col("h"), F.col("a"), F.col("opt"), F.col("leg_handicap"), F.col("hi_handicap_value")))
    return tickets(j.withColumn("leg_state", F.coalesce(state, F.lit("pending"))), F.window("closes_at", "1 minute").alias("w"))


def settle_on_result(spark: SparkSession, source: str, schema: str, legs: DataFrame, matches: DataFrame, table: str, checkpoint: str):
    """Starts a run over landed match updates, all columns of ``matches`` in each, that settles the bets they concern.

    A batch keeps its updates in a folder of its own and reads, of the updates so far, only those of the matches that its bets
    name: the folders are partitioned by bucket of match and only the buckets at hand are opened. Bets left pending are not
    written. Each batch writes its own folder below ``table``, so a repeated batch replaces its rows, and ``settled`` takes the
    newest row of a bet.
    """

    def settle(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        batch.select(*matches.columns, F.lit(epoch).cast("long").alias("epoch"), bucket_of().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/updates/batch={epoch}")
        own = session.read.parquet(f"{table}/updates/batch={epoch}").select(F.col("match_id").alias("mid")).distinct()
        hit = legs.join(own, "mid", "left_semi").select("bet_id").distinct()
        mine = written(legs.join(hit, "bet_id", "left_semi"), "legs")
        named = mine.select(F.col("mid").alias("match_id")).distinct().withColumn("bucket", bucket_of())
        buckets = [r["bucket"] for r in named.select("bucket").distinct().collect()]  # at most BUCKETS
        seen = session.read.parquet(f"{table}/updates").where((F.col("batch") <= epoch) & F.col("bucket").isin(buckets)).join(named.select("match_id"), "match_id", "left_semi")
        newest = seen.groupBy("match_id").agg(F.max_by(F.struct(*matches.columns), F.struct("epoch", F.to_json(F.struct(*matches.columns)))).alias("r")).select("r.*")
        then = matches.join(named.select("match_id"), "match_id", "left_semi").join(newest.select("match_id"), "match_id", "left_anti").select(*matches.columns)
        settle_bets(mine, typed(then.unionByName(newest))).where("status <> 'pending'").withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{table}/settled/batch={epoch}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, table: str) -> DataFrame:
    """The newest settlement of each bet that a run of ``settle_on_result`` has written."""
    rows = spark.read.parquet(f"{table}/settled").drop("batch")
    columns = [c for c in rows.columns if c != "epoch"]
    return rows.groupBy("bet_id").agg(F.max_by(F.struct(*columns), "epoch").alias("r")).select("r.*")
