from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from retenta.functions import (
    channel_key, first_of_month_text, matches_any, month_diff, month_start, part_from_right, whole_number,
    whole_years_between, zip_class,
)
from retenta.vocab import Vocabulary


def test_month_diff_counts_boundaries(values):
    pairs = [
        (date(2025, 2, 1), date(2025, 1, 31)), (date(2025, 1, 31), date(2025, 1, 1)), (date(2025, 1, 1), date(2024, 12, 31)),
        (date(2024, 12, 1), date(2025, 2, 1)), (None, date(2025, 1, 1)),
    ]
    assert values("a date, b date", pairs, month_diff) == [1, 0, 1, -2, None]


def test_whole_years_round_down_also_below_zero(values):
    end = date(2025, 12, 31)
    starts = [(end, date(2025, 1, 1)), (end, date(2024, 12, 1)), (end, date(2024, 11, 1)), (end, date(2026, 1, 1))]
    assert values("a date, b date", starts, whole_years_between) == [0, 1, 1, -1]


def test_month_start_is_a_date(values):
    assert values("a date", [date(2026, 6, 30), None], month_start) == [date(2026, 6, 1), None]


def test_first_of_month_text(values):
    assert values("a string", ["2026-06", None], first_of_month_text) == [date(2026, 6, 1), None]


def test_channel_key_needs_two_parts(values):
    assert values("a string", ["a/b/c", "a", "a//c", None, "a/b", ""], channel_key) == ["ab", None, "a", None, "ab", None]


def test_part_from_right(values):
    titles = ["card_5000_dup", "plain", "a_b_c_d_e", "a_b.c_d", "x__y", None]
    assert values("a string", titles, lambda c: part_from_right(c, 1)) == ["dup", "plain", None, "d", "y", None]
    assert values("a string", titles, lambda c: part_from_right(c, 2)) == ["5000", None, None, "c", None, None]
    assert values("a string", titles, lambda c: part_from_right(c, 3)) == ["card", None, None, "b", "x", None]


def test_whole_number_rounds_halves_away_from_zero(values):
    amounts = [Decimal("1.49"), Decimal("1.50"), Decimal("-1.50"), Decimal("2.50"), None]
    assert values("a decimal(18,2)", amounts, whole_number) == [1, 2, -2, 3, None]


def test_zip_class_with_missing_codes(values):
    pairs = [("123-456", None), ("04123", None), (None, None), (None, "04123"), ("04123", "123-456"), (None, "1-2")]
    assert values("h string, o string", pairs, zip_class) == ["old_zip", "new_zip", "", "new_zip", "old_zip", "old_zip"]


def test_name_words_hold_the_own_name_in_lower_case(values):
    words = Vocabulary(own_name="Relief Fund").commitment_name_words
    names = ["Kim TEST", "RELIEF FUND seoul", "김철수", "해피빈 01", None]
    assert values("a string", names, lambda c: matches_any(c, words)) == [True, True, False, True, None]


def test_three_valued_filters_drop_null(values):
    kept = values("a string", ["x", "2.%", None], lambda c: F.coalesce(c != "2.%", F.lit(False)))
    assert kept == [True, False, False]


def test_underscore_in_like_stands_for_one_character(values):
    assert values("a string", ["UP", "UPGRADE", "UP_X", None], lambda c: c.like("UP_%")) == [False, True, True, None]


def test_words_are_taken_literally(values):
    from retenta.functions import matches_any

    inputs = ["Care (Korea) donor", "carekorea", "A.B", "AxB", None]
    assert values("t string", inputs, lambda c: matches_any(c, ["care (korea", "a.b"])) == [True, False, True, False, None]
