"""Column functions: each takes columns and gives a column."""

from .handicap import DIALECTS, parse_handicap
from .movement import arrow, asian_label, asian_movement, bucket, euro_movement, moved
from .outcome import asian_result, index_result, leg_result, lower_plate, match_result, ou_result
from .scalars import clean_rank, confidence_mark, first_present, fixed, mean_or_zero, nonzero, pct, safe_double, safe_int, score_int, stars, strip_arrows, triple
from .times import match_number, match_status, match_time, normal_date, normal_time

__all__ = [
    "DIALECTS", "arrow", "asian_label", "asian_movement", "asian_result", "bucket", "clean_rank", "confidence_mark", "euro_movement", "first_present", "fixed", "index_result", "leg_result",
    "lower_plate", "match_number", "match_result", "match_status", "match_time", "mean_or_zero", "moved", "nonzero", "normal_date", "normal_time", "ou_result",
    "parse_handicap", "pct", "safe_double", "safe_int", "score_int", "stars", "strip_arrows", "triple",
]
