from .dates import first_of_month_text, month_diff, month_start, whole_years_between
from .rules import Band, Rule, above, band, classify, is_null, isin, like, one_of_like, rank_map, same, unlike
from .text import channel_key, matches_any, part_from_right, whole_number, zip_class

__all__ = [
    "Band", "Rule", "above", "band", "channel_key", "classify", "first_of_month_text", "is_null", "isin", "like",
    "matches_any", "month_diff", "month_start", "one_of_like", "part_from_right", "rank_map", "same", "unlike",
    "whole_number", "whole_years_between", "zip_class",
]
