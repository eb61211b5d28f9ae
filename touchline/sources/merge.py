"""Column-level upserts: keys present in an update win, others keep their value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import asian_label


def upsert(old: DataFrame, updates: DataFrame, key: list[str], seq: str = "seq", present: str = "present") -> DataFrame:
    """``old`` merged with ``updates``.

    An update row has the columns of ``old``, ``seq`` (its order) and ``present``, the names of the columns that it sets: a
    column set to '' replaces, one that is not named survives. New keys are added. One shuffle by the key; each column is
    the latest value among the rows that set it.
    """
    columns = [c for c in old.columns if c not in key]
    base = old.withColumns({seq: F.lit(-1).cast("long"), present: F.array(*[F.lit(c) for c in columns])})
    both = base.unionByName(updates.select(*old.columns, F.col(seq).cast("long").alias(seq), present))
    set_at = lambda c: F.when(F.array_contains(present, c), F.col(seq))
    # the value is wrapped, so that a column set to null wins too
    latest = [F.max_by(F.struct(F.col(c).alias("v")), set_at(c)).alias(c) for c in columns]
    return both.groupBy(*key).agg(*latest).select(*[F.col(k) for k in key], *[F.col(f"{c}.v").alias(c) for c in columns]).select(*old.columns)


def upsert_matches(old: DataFrame, updates: DataFrame, **options) -> DataFrame:
    """Updates without both team names, where they set them, are dropped first."""
    named = lambda c: ~F.array_contains("present", c) | F.nullif(c, F.lit("")).isNotNull()
    return upsert(old, updates.where(named("home_team") & named("away_team")), ["match_id"], **options)


def delete(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return old.join(keys.select(*on).distinct(), on, "left_anti")


#: The odds columns of a market: (field of the nested document, prefix of the columns, parts).
MARKETS = [("euro_odds", "euro", ("win", "draw", "lose")), ("asian_handicap", "asian", ("home_odds", "handicap", "away_odds")), ("over_under", "ou", ("over_odds", "total", "under_odds"))]
INDEX = ("home_odds", "draw_odds", "away_odds")
TIMES = ("euro_odds_update_time", "odds_update_time")


def _market_there(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def flatten_odds(odds: DataFrame) -> DataFrame:
    """Nested odds documents (match_id, seq, three market arrays, handicap_index struct, update times) as update rows for ``upsert``.

    The first element of each market becomes match columns, a key that it lacks ''; ``present`` names the columns of the
    markets that the document has. The movement label is set only where it can be told from this document's own Asian
    market. Documents without any market give no row.
    """
    columns, names = {}, []
    for field, prefix, parts in MARKETS:
        first = F.try_element_at(field, F.lit(1))
        mine = {f"{prefix}_{when}_{p}": F.when(_market_there(field), F.coalesce(first[f"{when}_{p}"], F.lit(""))) for when in ("initial", "current") for p in parts}
        columns |= mine
        names.append(F.when(_market_there(field), F.array(*[F.lit(c) for c in mine])))
    hi = F.col("handicap_index")
    index = {"hi_handicap_value": "handicap_value"} | {f"hi_{when}_{p}": f"{when}_{p}" for when in ("initial", "current") for p in INDEX}
    columns |= {k: F.when(hi.isNotNull(), F.coalesce(hi[v], F.lit(""))) for k, v in index.items()}
    names.append(F.when(hi.isNotNull(), F.array(*[F.lit(c) for c in index])))
    for c in TIMES:
        columns[c] = F.col(c)
        names.append(F.when(F.col(c).isNotNull(), F.array(F.lit(c))))
    some = hi.isNotNull()
    for field, _, _ in MARKETS:
        some = some | _market_there(field)
    flat = odds.where(some).select("match_id", "seq", *[v.alias(k) for k, v in columns.items()], F.flatten(F.array_compact(F.array(*names))).alias("present"))
    label = asian_label(*[F.col(f"asian_{w}_{p}") for p in ("handicap", "home_odds") for w in ("initial", "current")])
    flat = flat.withColumn("asian_movement_label", label)
    return flat.withColumn("present", F.when(F.col("asian_movement_label").isNotNull(), F.array_append("present", "asian_movement_label")).otherwise(F.col("present")))


def upsert_odds(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """``matches`` with the odds columns of the documents merged in by ``seq``; documents of unknown matches change nothing."""
    flat = flatten_odds(odds)
    mine = [c for c in matches.columns if c in flat.columns]
    known = flat.join(matches.select("match_id"), "match_id", "left_semi")
    updates = known.select(*[F.col(c) if c in mine else F.lit(None).cast(t).alias(c) for c, t in matches.dtypes], "seq", "present")
    return upsert(matches, updates, ["match_id"])


def latest_odds(old: DataFrame, new: DataFrame) -> DataFrame:
    """The odds documents themselves: the newest of each match replaces the old one; those without a market are skipped."""
    some = F.col("handicap_index").isNotNull()
    for field, _, _ in MARKETS:
        some = some | _market_there(field)
    both = old.unionByName(new.where(some))
    rest = [c for c in old.columns if c != "match_id"]
    return both.groupBy("match_id").agg(F.max_by(F.struct(*rest), "seq").alias("d")).select("match_id", "d.*").select(*old.columns)


def combined(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """Matches with the 27 odds columns of the combined files: initial, current and, under the older names, current again; '' where a match has none."""
    flat = flatten_odds(odds)
    columns = [f"{prefix}_{when}_{p}" for _, prefix, parts in MARKETS for when in ("current", "initial") for p in parts]
    older = {f"{prefix}_{p}": f"{prefix}_current_{p}" for _, prefix, parts in MARKETS[:2] for p in parts} | {"over_odds": "ou_current_over_odds", "total_goals": "ou_current_total", "under_odds": "ou_current_under_odds"}
    named = flat.select("match_id", *columns, *[F.col(v).alias(k) for k, v in older.items()])
    columns += list(older)
    keep = [c for c in matches.columns if c not in columns]
    return matches.select(*keep).join(named, "match_id", "left").select(*keep, *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def backfill_labels(matches: DataFrame) -> DataFrame:
    """``matches`` with the movement label computed anew from its own lines and odds; where none can be told the old one stays."""
    label = asian_label(*[F.col(f"asian_{w}_{p}") for p in ("handicap", "home_odds") for w in ("initial", "current")])
    return matches.withColumn("asian_movement_label", F.coalesce(label, F.col("asian_movement_label")))
