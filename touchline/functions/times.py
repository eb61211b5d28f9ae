"""Times, statuses and match numbers as feeds and pages write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status code of the feed -> ours, and words for live and finished.
FEED_STATUS = {"0": 0, "1": 1, "2": 1, "3": 1, "4": 2, "6": 6}
WEEKDAYS = "一二三四五六日"


def match_status(code: Column, text: Column) -> Column:
    """0 not started, 1 live, 2 finished, 6 rescheduled: by the feed's code, else by the text."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in FEED_STATUS.items() for x in pair]), code)
    by_text = F.when(text.rlike("完|结束"), 2).when(text.rlike("改期"), 6).when(text.rlike("未|推迟|取消"), 0).otherwise(1)
    return F.coalesce(known, by_text)


def match_time(text: Column, year: Column | None = None) -> Column:
    """Timestamp of four formats; 'MM-dd HH:mm' gets ``year`` (the current one if left out); null if none fits."""
    year = F.year(F.current_date()) if year is None else year
    short = F.when(text.rlike(r"^[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$"), F.concat(year.cast("string"), F.lit("-"), text))
    tries = [F.try_to_timestamp(short, F.lit("yyyy-MM-dd HH:mm"))]
    for pattern, shape in (("yyyy-MM-dd HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), ("yyyy-MM-dd HH:mm", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$"), ("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")):
        tries.append(F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(pattern)))
    return F.coalesce(*tries)


def normal_time(text: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' -> 'MM-dd HH:mm'; other text stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), "MM-dd HH:mm"), text)


def normal_date(text: Column) -> Column:
    """Eight digits get their dashes."""
    return F.regexp_replace(text, "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")


def match_number(text: Column) -> Column:
    """周一001 -> 1001 up to 周日 -> 7; null for other prefixes."""
    day = F.instr(F.lit(WEEKDAYS), F.substring(text, 2, 1))
    good = text.rlike(f"^周[{WEEKDAYS}][0-9]+$")
    return F.when(good, F.concat(day.cast("string"), F.substring(text, F.lit(3), F.length(text))))
