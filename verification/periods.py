"""The periods the registered queries report on (the test tables run from 1995 to 2001)."""

from datetime import date, datetime

from retenta import Period

MONTH = Period.month(1998, 6)
QUARTER = Period.quarter(1998, 2)
HALF = Period.half(1998, 1)
YTD = Period.ytd(1998, 6)
YEAR = Period.year(1998)
TRAILING = Period.trailing(1998, 6)
LEDGER_MONTH = Period.month(2024, 1)
AS_OF = date(1998, 7, 1)
LOADED_AT = datetime(1998, 7, 1, 6, 0, 0)
HISTORY = Period.trailing(1998, 12, 24)
