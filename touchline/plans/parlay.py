"""Candidates and the search for the best pair or combination.

A band of odds holds few distinct values however many candidates there are. The first candidates of each value stand for all
of them, and the search meets in the middle over these values: products of pairs are sorted once in a task, and each product
of the other legs looks up its complement, within a distance of the target that widens until enough combinations are found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import first_present, pct
from ..operators.results import count_of
from ..operators.teams import team_profile
from ..store import small_side, written
from .bets import money

def _in_order() -> list[Column]:
    """Candidates as their matches are listed, newest match_time first, and by kind within a match."""
    return [F.desc_nulls_last("match_time"), F.desc("match_id"), F.asc("k")]


def _price(text: str) -> Column:
    """The number of a text; 0 for an absent one, null for one that is no number."""
    return F.coalesce(first_present(F.col(text)), F.lit("0")).try_cast("double")


def _upcoming(m: DataFrame) -> DataFrame:
    prices = {"p_win": "euro_initial_win", "p_draw": "euro_initial_draw", "p_lose": "euro_initial_lose", "p_line": "ou_initial_total"}
    return m.where("status = 0").withColumns({k: _price(v) for k, v in prices.items()} | {"p_over": _price("ou_initial_over_odds") + 1.0})


def _known(*names: str) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"p_{n}").isNotNull()
    return test


def _candidate(k: int, name: str, odds: str) -> Column:
    return F.struct(F.lit(k).alias("k"), F.lit(name).alias("type"), F.col(odds).alias("odds"))


def _listed(rows: DataFrame, *choices: Column) -> DataFrame:
    rows = rows.select("match_id", "match_time", F.explode(F.array_compact(F.array(*choices))).alias("c"))
    return rows.select("match_id", "match_time", "c.k", "c.type", "c.odds")


def high_odds_candidates(m: DataFrame) -> DataFrame:
    """Up to two candidates a match: a side at 1.65 to 1.95 (home before away), and over at 1.70 to 2.00 with a line of 2.5 or more.

    Home or away odds that are no number leave a match without candidates; a line or over odds that are none cost the over only.
    """
    win, lose, over, line = (F.col(f"p_{x}") for x in ("win", "lose", "over", "line"))
    sides = _known("win", "lose")
    side = F.when(sides & win.between(1.65, 1.95), _candidate(1, "主胜", "p_win")).when(sides & lose.between(1.65, 1.95), _candidate(2, "客胜", "p_lose"))
    big = F.when(sides & over.between(1.70, 2.0) & (line >= 2.5), _candidate(3, "大球", "p_over"))
    return _listed(_upcoming(m), side, big)


def _profiled(m: DataFrame) -> DataFrame:
    """Upcoming matches with the win, loss and big-game rates of both teams; a missing profile gives nulls."""
    p = team_profile(m)
    rates = {"win": 100 * F.col("wins") / F.col("matches"), "loss": 100 * F.col("losses") / F.col("matches"), "big": 100 * F.col("big_games") / F.col("matches")}
    u = _upcoming(m)
    for side in ("home", "away"):
        u = u.join(p.select(F.col("team").alias(f"{side}_team"), *[r.alias(f"{side}_{k}") for k, r in rates.items()]), f"{side}_team", "left")
    return u


def profile_candidates(m: DataFrame) -> DataFrame:
    """Up to three candidates a match by odds bands and the profiles of both teams; a missing profile counts as rates of 0.

    A match with odds or a line that are no number has none.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    win, lose, over, line = (F.col(f"p_{x}") for x in ("win", "lose", "over", "line"))
    home = F.when(win.between(1.5, 2.0) & ((z("home_win") >= 40) | (z("away_loss") >= 40)), _candidate(1, "主胜", "p_win"))
    away = F.when(lose.between(1.5, 2.0) & ((z("away_win") >= 40) | (z("home_loss") >= 40)), _candidate(2, "客胜", "p_lose"))
    big = F.when(over.between(1.7, 2.0) & (line >= 2.5) & (((z("home_big") + z("away_big")) / 2 >= 50) | (line >= 3.0)), _candidate(3, "大球", "p_over"))
    return _listed(_profiled(m).where(_known("win", "lose", "over", "line")), home, away, big)


#: Odds count in millionths at the finest, so that products are whole numbers and ties are exact.
PLACES = 6


def _first_of_values(candidates: DataFrame, each: int, one_of_match: bool) -> DataFrame:
    """(v, match_id, k, pos): of each value of the odds, in millionths, the first ``each`` candidates, or matches, in order. Odds not above 0 are none."""
    w = Window.partitionBy("v").orderBy(*_in_order())
    few = candidates.where("odds > 0").select("match_id", "match_time", "k", F.round(F.col("odds") * 10**PLACES).cast("long").alias("v")).where("v > 0")
    # a match has at most three candidates: 3 * each rows hold each matches; the limit works before the shuffle
    few = few.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= (3 * each if one_of_match else each))
    if one_of_match:
        few = few.groupBy("v", "match_id").agg(F.min("k").alias("k"), F.max("match_time").alias("match_time"))
        few = few.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each)
    place = F.row_number().over(Window.orderBy(*_in_order()))  # as many rows as values of the odds, times ``each``
    return written(few.select("v", "match_id", "k", place.alias("pos")), "candidates")


def _complements(v: list[int], m: list[int], n: int, aim: int, reach: float):
    """Rows (i): the combinations i <= i2 <= ... of value numbers whose product is within ``reach`` of ``aim``, no value more often than its ``m``.

    The products of two legs (one for pairs), sorted, are searched for the complement of each product of the others, so no
    more of them are held than the square of the values, and only what is near enough is formed.
    """
    def run(batches):
        x, size = np.array(v, dtype=np.float64), len(v)
        a, b = (np.arange(size), np.arange(size)) if n == 2 else np.triu_indices(size)
        products = x if n == 2 else x[a] * x[b]
        order = np.argsort(products, kind="stable")
        a, b, products = a[order], b[order], products[order]
        for batch in batches:
            for first in batch.column(0).to_pylist():
                rest = np.arange(first, size)
                if n <= 3:
                    left = np.array([[first]])
                elif n == 4:
                    left = np.stack([np.full(len(rest), first), rest], axis=1)
                else:
                    i, j = np.triu_indices(len(rest))
                    left = np.stack([np.full(len(i), first), rest[i], rest[j]], axis=1)
                own = x[left].prod(axis=1)
                low = np.searchsorted(products, (aim - reach) / own * (1 - 1e-12), "left")
                high = np.searchsorted(products, (aim + reach) / own * (1 + 1e-12), "right")
                ends = np.cumsum(high - low)
                for at in range(0, int(ends[-1]), 1 << 20):
                    flat = np.arange(at, min(at + (1 << 20), int(ends[-1])))
                    row = np.searchsorted(ends, flat, "right")
                    pair = high[row] - (ends[row] - flat)
                    right = a[pair][:, None] if n == 2 else np.stack([a[pair], b[pair]], axis=1)
                    both = np.concatenate([left[row], right], axis=1)
                    both = both[both[:, left.shape[1]] >= both[:, left.shape[1] - 1]]
                    out = []
                    for numbers in both.tolist():
                        if all(numbers.count(k) <= m[k] for k in set(numbers)):
                            product = math.prod(v[k] for k in numbers)
                            if abs(product - aim) <= reach:
                                out.append([*[v[k] for k in numbers], str(product), str(abs(product - aim))])
                    if out:
                        cols = list(zip(*out))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:n]] + [pa.array(c) for c in cols[n:]], [*[f"v_{i}" for i in range(1, n + 1)], "product", "off"])

    return run


def _nearest(few: DataFrame, n: int, target: float, top: int = 1, low: float | None = None, high: float | None = None) -> tuple[DataFrame, int]:
    """The ``top`` combinations of ``n`` rows of ``few`` of different matches with products nearest to ``target``: (off, product, legs), and the places.

    The values of the odds, a few hundred to a few thousand, come to the driver; the combinations don't. The distance begins
    where some fifty combinations are expected and grows until ``top`` are found, or everything, or the band, is within it.
    """
    spark = few.sparkSession
    counted = sorted((r["v"], r["m"]) for r in few.groupBy("v").agg(F.count_distinct("match_id").alias("m")).collect())
    # as few places as tell all values, so that products stay short; fewer where 38 digits would not hold a product
    places = next(p for p in range(PLACES + 1) if p == PLACES or all(v % 10 ** (PLACES - p) == 0 for v, _ in counted))
    most = max((v for v, _ in counted), default=1) / 10**PLACES
    while places and n * (places + math.log10(max(most, 1.0))) > 37.5:
        places -= 1
    unit = 10 ** (PLACES - places)
    held: dict[int, int] = {}
    for v, m in counted:
        held[max(1, round(v / unit))] = held.get(max(1, round(v / unit)), 0) + m
    v, m = list(held), list(held.values())
    few = few.withColumn("v", F.greatest(F.lit(1), F.round(F.col("v") / unit)).cast("long"))
    scale = 10 ** (places * n)
    aim = round(target * scale)
    far = max([abs(min(v) ** n - aim), abs(max(v) ** n - aim)]) if v else 0
    if low is not None:
        far = min(far, max(aim - round(low * scale), round(high * scale) - aim))
    names, schema = [f"v_{i}" for i in range(1, n + 1)], ", ".join([*[f"v_{i} long" for i in range(1, n + 1)], "product string", "off string"])
    reach = min(far, int(max(v) ** n - min(v) ** n) * 50 // max(1, math.comb(len(v) + n - 1, n)) if v else 0)
    firsts = spark.range(0, len(v), 1, max(1, min(len(v), 64)))
    while True:
        t = firsts.mapInArrow(_complements(v, m, n, aim, reach), schema).withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("product", "off")})
        if low is not None:
            t = t.where(F.col("product").between(round(low * scale), round(high * scale)))
        # the nearest first: most searches end with a few hundred of them, and those of the same distance
        t = written(t, "combinations")
        bar = t.orderBy("off").limit(256).agg(F.max("off")).first()[0]
        for near in ([bar] if bar is not None else []) + [None]:
            found = written(_filled(t if near is None else t.where(F.col("off") <= F.lit(near)), few, n, names).orderBy("off", "legs").limit(top), "found")
            if near is not None and found.count() >= top:
                return found, places
        if reach >= far or found.count() >= top:
            return found, places
        reach = min(far, max(16 * reach, 1))


def _filled(t: DataFrame, few: DataFrame, n: int, names: list[str]) -> DataFrame:
    """The combinations of values with legs of different matches in their places; of equal values the earlier leg first."""
    few = small_side(few)
    for i in range(1, n + 1):
        t = t.join(few.select(F.col("v").alias(f"v_{i}"), F.struct("pos", "match_id", "k", "v").alias(f"leg_{i}")), f"v_{i}")
        for j in range(1, i):
            a, b = F.col(f"leg_{j}"), F.col(f"leg_{i}")
            t = t.where((a["match_id"] != b["match_id"]) & ((F.col(f"v_{j}") != F.col(f"v_{i}")) | (a["pos"] < b["pos"])))
    return t.select("off", "product", F.array_sort(F.array(*[f"leg_{i}" for i in range(1, n + 1)])).alias("legs"))


def _legs(found: DataFrame, n: int, places: int) -> tuple[list[Column], list[Column], Column, Column]:
    leg = lambda i: F.element_at("legs", i)
    unit, scale = float(10**places), float(10 ** (places * n))
    keys = [leg(i)[c].alias(f"{name}_{i}") for i in range(1, n + 1) for c, name in (("match_id", "match"), ("k", "k"))]
    return keys, [(leg(i)["v"] / unit).alias(f"odds_{i}") for i in range(1, n + 1)], (F.col("product").cast("double") / scale).alias("product"), (F.col("off").cast("double") / scale).alias("diff")


def best_pair(candidates: DataFrame, target: float = 3.0, low: float | None = None, high: float | None = None, top: int = 1) -> DataFrame:
    """The ``top`` pairs of different matches whose product is nearest to ``target``, within [low, high] if given; ties in candidate order.

    Odds of any number of places count to the nearest millionth, so that ties are exact. Of the candidates of one value the
    first ``3 * top + 3`` suffice: a later one has enough earlier ones of other matches that pair as well.
    """
    found, places = _nearest(_first_of_values(candidates, 3 * top + 3, one_of_match=False), 2, target, top, low, high)
    keys, odds, _, diff = _legs(found, 2, places)
    return found.orderBy("off", "legs").select(*keys, *odds, diff)


def full_analysis_candidates(m: DataFrame) -> DataFrame:
    """At most one candidate a match: home win, else away win, else over, each by its odds band and the profiles of the teams."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    win, lose, over, line = (F.col(f"p_{x}") for x in ("win", "lose", "over", "line"))
    home = win.between(1.65, 1.95) & (z("home_win") >= 50)
    away = lose.between(1.65, 1.95) & (z("away_win") >= 50)
    big = over.between(1.7, 2.0) & (line >= 2.5) & (((z("home_big") + z("away_big")) / 2 >= 50) | (line >= 3.0))
    pick = F.when(home, _candidate(1, "主胜", "p_win")).when(away, _candidate(2, "客胜", "p_lose")).when(big, _candidate(3, "大球", "p_over"))
    return _listed(_profiled(m).where(_known("win", "draw", "lose", "over", "line")), pick)


def banker_candidates(m: DataFrame) -> DataFrame:
    """Home wins at 1.30 to 1.60, and over at a fixed 1.85 for lines of 3 or more; matches without home odds above 1.01 give none."""
    home = F.when(F.col("win0").between(1.30, 1.60), F.struct(F.lit(1).alias("k"), F.lit("主胜").alias("type"), F.col("win0").alias("odds")))
    big = F.when(F.col("p_line") >= 3.0, F.struct(F.lit(3).alias("k"), F.lit("大球").alias("type"), F.lit(1.85).alias("odds")))
    return _listed(_upcoming(m).where("win0 > 1.01"), home, big).drop("match_time")


def banker_pair(candidates: DataFrame, apart: bool = False) -> DataFrame:
    """The two candidates of lowest odds, ties by match and kind; no row for fewer than two.

    Both may be of one match unless ``apart``; as a match has at most two candidates, the three lowest hold the answer then.
    """
    low = candidates.orderBy("odds", "match_id", "k").limit(3 if apart else 2)
    rows = low.agg(F.array_sort(F.collect_list(F.struct("odds", "match_id", "k"))).alias("r")).withColumn("first", F.try_element_at("r", F.lit(1)))
    others = F.filter(F.slice("r", 2, 2), lambda x: x["match_id"] != F.col("first.match_id")) if apart else F.slice("r", 2, 1)
    rows = rows.withColumn("second", F.try_element_at(others, F.lit(1))).where("second IS NOT NULL")
    out = [F.col(f"{side}.{c}").alias(f"{name}_{i}") for i, side in ((1, "first"), (2, "second")) for c, name in (("match_id", "match"), ("k", "k"), ("odds", "odds"))]
    return rows.select(*out, (F.col("first.odds") * F.col("second.odds")).alias("product"))


def low_odds_backtest(m: DataFrame, low: float = 1.1, high: float = 1.65) -> DataFrame:
    """Backing every home side at initial odds within (low, high): hits, hit rate and return on stakes of 1, by league and over all (league null, whole 1)."""
    f = m.where("status = 2 AND result IS NOT NULL").where((F.col("win0") > low) & (F.col("win0") < high)).withColumn("lg", F.coalesce("league", F.lit("")))
    hit = F.col("result") == "home"
    g = f.rollup("lg").agg(F.grouping("lg").cast("int").alias("whole"), F.count("*").alias("n"), count_of(hit).alias("hits"), money(F.when(hit, F.col("win0"))).alias("returned"))
    return g.select(F.when(F.col("whole") == 0, F.col("lg")).alias("league"), "whole", "n", "hits", pct(F.col("hits"), F.col("n")).alias("hit_pct"), "returned", pct(F.col("returned") - F.col("n"), F.col("n")).alias("roi_pct"))


def low_odds_pick(m: DataFrame, seed: int, n: int = 2, low: float = 1.1, high: float = 1.65) -> DataFrame:
    """``n`` random finished matches with initial home odds within (low, high), and the product that backing them all returned, else 0.

    The choice follows from ``seed`` and the match ids alone: the smallest hashes are taken.
    """
    f = m.where("status = 2 AND result IS NOT NULL").where((F.col("win0") > low) & (F.col("win0") < high))
    rows = f.select("match_id", F.col("win0").alias("odds"), (F.col("result") == "home").alias("hit"), F.sha2(F.concat_ws(":", F.lit(str(seed)), "match_id"), 256).alias("draw")).orderBy("draw").limit(n)
    g = rows.agg(F.count("*").alias("legs"), F.array_sort(F.collect_list(F.struct("draw", "match_id", "odds"))).alias("r"), F.bool_and("hit").alias("won"))
    product = F.aggregate("r", F.lit(1.0), lambda acc, x: acc * x["odds"])
    return g.where("legs > 0").select("legs", F.array_join(F.transform("r", lambda x: x["match_id"]), ",").alias("matches"), product.alias("product"), F.when(F.col("won"), product).otherwise(0.0).alias("returned"))


def n_fold(candidates: DataFrame, n: int = 2, target: float = 3.0) -> DataFrame:
    """The combination of ``n`` different matches, 2 to 5, whose product of odds is nearest to ``target``; none, no row.

    Odds of any number of places count to the nearest millionth, so that products are whole numbers and ties are exact; ties go
    to the combination that comes first in candidate order, and its legs stand in that order. Of each value of the odds the
    first ``n`` matches suffice: a chosen match beyond them can always be replaced by an earlier one that is free.
    """
    if not 2 <= n <= 5:
        raise ValueError("n is 2 to 5")
    found, places = _nearest(_first_of_values(candidates, n, one_of_match=True), n, target)
    keys, odds, product, diff = _legs(found, n, places)
    return found.select(*keys, *odds, product, diff)
