from datetime import date

from retenta import Period


def test_ranges():
    assert (Period.month(2026, 12).start, Period.month(2026, 12).end_exclusive) == (date(2026, 12, 1), date(2027, 1, 1))
    assert (Period.quarter(2026, 2).start, Period.quarter(2026, 2).last_day) == (date(2026, 4, 1), date(2026, 6, 30))
    assert (Period.half(2026, 2).start, Period.half(2026, 2).last_day) == (date(2026, 7, 1), date(2026, 12, 31))
    assert (Period.ytd(2026, 6).start, Period.ytd(2026, 6).last_day) == (date(2026, 1, 1), date(2026, 6, 30))
    assert (Period.trailing(2026, 6).start, Period.trailing(2026, 6).last_day) == (date(2025, 7, 1), date(2026, 6, 30))
    assert Period.trailing(2026, 12).start == date(2026, 1, 1)
    assert Period.year(2025).last_day == date(2025, 12, 31)


def test_labels_and_shift():
    assert Period.month(2026, 6).yymm == "2606"
    assert Period.quarter(2026, 2).label == "2026Q2"
    early = Period.month(2026, 6).shifted(-1)
    assert (early.start, early.last_day) == (date(2026, 5, 31), date(2026, 6, 29))


def test_holds_is_half_open(values):
    june = Period.month(2026, 6)
    days = [date(2026, 5, 31), date(2026, 6, 1), date(2026, 6, 30), date(2026, 7, 1), None]
    assert values("d date", days, june.holds) == [False, True, True, False, None]
    texts = ["20251231", "20260101", "20261231", "20270101"]
    assert values("d string", texts, Period.year(2026).holds_text) == [False, True, True, False]
