"""Labels that the report rules must give, written by hand: one label for each value of the stand-in tables.

Nothing here comes from ``retenta.vocab``, so a wrong rule makes a result differ. A value that is not listed becomes
``NOT LISTED`` and makes the result differ too. None stands for NULL.
"""

from __future__ import annotations

from collections.abc import Mapping

# The channels of the report, with what is expected of each ladder over them.
RECRUIT_CHANNEL = {
    "F2F SW": "F2F SW", "F2F SW A": "F2F SW", "F2F SW B2B": "F2F SW", "F2F SW B2B East": "F2F SW", "F2F APPCO X": "F2F SW",
    "F2F DN A": "F2F DN", "F2F KDA": "F2F KDA", "F2F IH A": "F2F IH A", "F2F IH": "F2F IH", "ONLINE": "ONLINE", "DRTV": "DRTV",
    "Multi_SMS": "Multi_SMS", "Multi_DRTV": "Multi_DRTV", "UPGRADE": "UPGRADE", "UP_X": "UP_X", "ONEOFF": "ONEOFF",
    "Reactivation": "Reactivation", "Conversion": "Conversion", "PPHCORP": "PPHCORP", "Cash DM": "Cash DM", None: None,
}
F2F_TYPE = {
    "F2F SW": "Street", "F2F SW A": "Street", "F2F SW B2B": "B2B", "F2F SW B2B East": "Street", "F2F APPCO X": "Street",
    "F2F DN A": "Street", "F2F KDA": "Street", "F2F IH A": "Street", "F2F IH": "Street", "ONLINE": "Other", "DRTV": "Other",
    "Multi_SMS": "Other", "Multi_DRTV": "Other", "UPGRADE": "Other", "UP_X": "Other", "ONEOFF": "Other", "Reactivation": "Other",
    "Conversion": "Other", "PPHCORP": "Other", "Cash DM": "Other", None: "Other",
}
F2F_DETAIL = {
    "F2F SW": "F2F SW", "F2F SW A": "F2F SW A", "F2F SW B2B": "F2F SW B2B", "F2F SW B2B East": "F2F SW B2B East",
    "F2F APPCO X": "F2F APPCO X", "F2F DN A": "F2F DN A", "F2F KDA": "F2F KDA", "F2F IH A": "F2F IH A", "F2F IH": "F2F IH",
    "ONLINE": "Not F2F", "DRTV": "Not F2F", "Multi_SMS": "Not F2F", "Multi_DRTV": "Not F2F", "UPGRADE": "Not F2F", "UP_X": "Not F2F",
    "ONEOFF": "Not F2F", "Reactivation": "Not F2F", "Conversion": "Not F2F", "PPHCORP": "Not F2F", "Cash DM": "Not F2F", None: "Not F2F",
}
_NOT_F2F = ("ONLINE", "DRTV", "Multi_SMS", "Multi_DRTV", "UPGRADE", "UP_X", "ONEOFF", "Reactivation", "Conversion", "PPHCORP", "Cash DM", None)
RG_CHANNEL_G1 = {
    **{c: "F2F TOTAL" for c in RECRUIT_CHANNEL if c not in _NOT_F2F}, "ONLINE": "Online", "DRTV": "DRTV",
    "Multi_SMS": "Multi_Digital/SMS", "Multi_DRTV": "DRTV_SMS/Multi_MAIL/NEWSPAPER/Magazine", "UPGRADE": "UPGRADE", "UP_X": "UP_X",
    "ONEOFF": "ONEOFF", "Reactivation": "Reactivation", "Conversion": "Conversion", "PPHCORP": "PPHCORP", "Cash DM": "Cash DM", None: None,
}
RG_CHANNEL_G2 = {
    "F2F SW": "F2F AGENCY", "F2F SW A": "F2F AGENCY", "F2F SW B2B": "F2F AGENCY", "F2F SW B2B East": "F2F AGENCY",
    "F2F APPCO X": "F2F APPCO X", "F2F DN A": "F2F AGENCY", "F2F KDA": "F2F AGENCY", "F2F IH A": "F2F IH", "F2F IH": "F2F IH",
    "ONLINE": "ONLINE", "DRTV": "DRTV", "Multi_SMS": "ONLINE", "Multi_DRTV": "DRTV", "UPGRADE": "UPGRADE", "UP_X": "UP_X",
    "ONEOFF": "ONEOFF", "Reactivation": "Reactivation", "Conversion": "Conversion", "PPHCORP": "PPHCORP", "Cash DM": "Cash DM", None: None,
}
# The underscore of these two ladders stands for any one character.
RG_CHANNEL_G3 = {
    "F2F SW": "F2F SW_Street", "F2F SW A": "F2F SW_Street", "F2F SW B2B": "F2F SW_B2B", "F2F SW B2B East": "F2F SW_B2B",
    "F2F APPCO X": "Not F2F Agency", "F2F DN A": "F2F DN", "F2F KDA": "F2F KDA", "F2F IH A": "F2F IH", "F2F IH": "F2F IH",
    **dict.fromkeys(_NOT_F2F, "Not F2F Agency"),
}
RG_CHANNEL_G4 = {
    "F2F SW": "F2F SW", "F2F SW A": "F2F SW", "F2F SW B2B": "F2F SW", "F2F SW B2B East": "F2F SW", "F2F APPCO X": "F2F APPCO X",
    "F2F DN A": "F2F DN", "F2F KDA": "F2F KDA", "F2F IH A": "F2F IH", "F2F IH": "F2F IH", **{c: c for c in _NOT_F2F},
}
# The channels of the one-off profile: the full name, and the key before it for the third ladder.
OO_CHANNEL_GB1 = {
    "F2FSWA": "F2F TOTAL", "F2FSWB2B": "F2F TOTAL", "F2FDNA": "F2F TOTAL", "F2FIH": "F2F TOTAL", "ONLINE": "ONLINE", "DRTV": "DRTV",
    "UPGRADE": "UPGRADE", "PPHCORP": "PPH", "MAILWITHU": "HCR_COMP/MAIL/OTHER", "Multi_SMS": "Multi_Digital/SMS", None: None,
}
OO_CHANNEL_GB2 = {
    "F2FSWA": "F2F AGENCY", "F2FSWB2B": "F2F AGENCY", "F2FDNA": "F2F AGENCY", "F2FIH": "F2F IH", "ONLINE": "ONLINE_T",
    "DRTV": "DRTV_T", "UPGRADE": "UPGRADE", "PPHCORP": "PPH_T", "MAILWITHU": "HCR_COMP/MAIL/OTHER", "Multi_SMS": "ONLINE_T", None: None,
}
OO_CHANNEL_GB3 = {
    "F2FSWA": "F2F SW_T", "F2FSWB2B": "F2F SW_B2B_T", "F2FDNA": "F2F DN_T", "F2FIH": "F2F IH_T", "ONLINE": "ONLINE_T",
    "DRTV": "DRTV_T", "UPGRADE": "UPGRADE", "PPHCORP": "PPH_T", "MAILWITHU": "HCR_COMP/MAIL/OTHER", "Multi_SMS": "ONLINE_T", None: None,
}
OO_CHANNEL_SHORT = {
    "F2F AGENCY": "F2F AGENCY", "F2F IH": "F2F IH", "ONLINE_T": "ONLINE", "DRTV_T": "DRTV", "UPGRADE": "UPGRADE", "PPH_T": "PPH",
    "HCR_COMP/MAIL/OTHER": "Others", None: None,
}
PLEDGE_STATUS = {"종료": "end", "진행": "progress", "대기": "?"}
ENROL_TYPE = {"개인": "Individual", "기업/단체": "Group", "외국인": "Foreigner", None: None}
# Campaigns of gifts; the key decides nothing here, the name does.
CASH_TYPE = {"Cash_SMS": "Cash_SMS", "Cash_DM/1": "Cash_DM", "Cash_EMAIL": "Cash_EMAIL", "X Cash_MULTI": "Cash_MULTI", "Cash_OTHER": None}
RG_CASH_TYPE = {**CASH_TYPE, "Cash_OTHER": "No_cash_donor"}
EARMARK = {"Syria Emergency": "SYR ER", "Unearmarked Donations": "Unearmarked", "Other Emergency Fund": "Other ER", None: "General"}
REGION_GROUPS = {
    "서울특별시": "서울,경기,인천", "경기도": "서울,경기,인천", "인천광역시": "서울,경기,인천", "대구광역시": "대구,경북",
    "부산광역시": "부산,울산,경남", "광주광역시": "광주,전라", "세종특별자치시": "대전,충청,세종", "강원도": "강원",
    "제주특별자치도": "제주", "NA": "No data", "": "No data", None: "No data",
}
REGION_CLASSES = {
    "서울특별시": "Seoul Metropolitan Area", "경기도": "Seoul Metropolitan Area", "인천광역시": "Seoul Metropolitan Area",
    "대구광역시": "Urban Cities", "부산광역시": "Urban Cities", "광주광역시": "Urban Cities", "세종특별자치시": "Other Provinces",
    "강원도": "Other Provinces", "제주특별자치도": "Other Provinces", "NA": "No data", "": "No data", None: "No data",
}
COLLECTOR_ROUTE = {"고객해지(PayInfo-고객)": "PayInfo", "고객해지(PayInfo-금융기관)": "PayInfo", "고객해지(금융기관)": "Bank", "기타": "Bank", None: "Bank"}
# Route and reason of a cancellation.
OFFICE = "후원자관리팀"
CANCEL_ROUTE = {"홈페이지": "OWN ORGANISATION Website", "전화": "Donorcare line", "콜센터 IN": "Donorcare line", "이메일": "Email/Mail", "우편": "Email/Mail", None: "Donorcare line"}
# Account holders of the bank ledger whose class depends on the name alone.
LEDGER_NAMES = {
    "네이버페이01": "네이버페이", "KT02X": "KT", "X/UK": "베네비티", "지로입금": "지로", "나이스정보통신": "PG", "해피빈재단": "해피빈",
    "카카오": "카카오스토리펀딩", "카카오페이9": "카카오페이", "신한81": "신한카드 포인트", "신한카드자금": "신한카드 포인트",
    "A KB포": "KB카드 포인트", "A 국민카드": "KB카드 포인트", "donor": "", None: "",
}


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def label_sql(column: str, labels: Mapping[str | None, str | None]) -> str:
    """The expected label of a column's value."""
    listed = " ".join(f"WHEN {column} IS NOT DISTINCT FROM {_text(k)} THEN {_text(x)}" for k, x in labels.items())
    return f"CASE {listed} ELSE 'NOT LISTED' END"


def cash_sql(column: str, labels: Mapping[str | None, str | None]) -> str:
    """Cash types by campaign, of campaigns that hold the word."""
    return f"if(contains({column}, 'Cash'), {label_sql(column, labels)}, {_text(labels['Cash_OTHER'])})"


LEDGER_SQL = f"""CASE WHEN gb = '취소' OR spend_out > 0 OR name IN ('이자세금', 'OWN ORGANISATION', '공인인증서발급수수료1') THEN '제외'
  WHEN tran_method = 'CMS 공동' THEN 'CMS'
  WHEN name = '하나91Z' THEN if(bank = '하나은행', '하나카드 포인트', '')
  ELSE {label_sql('name', LEDGER_NAMES)} END"""


def above(value: str, *steps: tuple[str, str], last: str) -> str:
    """Labels by the first upper edge that a value does not exceed, else ``last``; NULL gives the label named "NULL"."""
    null = [label for edge, label in steps if edge == "NULL"]
    rest = " ".join(f"WHEN {value} <= {edge} THEN {_text(label)}" for edge, label in steps if edge != "NULL")
    return f"CASE {f'WHEN {value} IS NULL THEN {_text(null[0])} ' if null else ''}{rest} ELSE {_text(last)} END"


def rg_age(value: str) -> str:
    return above(f"nullif(greatest({value}, 0), 0)", ("NULL", "No data"), ("18", "under 18"), ("25", "19~25"), ("30", "26~30"), ("40", "31~40"), ("50", "41~50"), ("60", "51~60"), last="over 61")


def oo_age(value: str) -> str:
    return above(value, ("NULL", "No data"), ("18", "under 18"), ("25", "19~25"), ("30", "26~30"), ("40", "31~40"), ("50", "41~50"), ("60", "51~60"), last="over 61")


def rg_gift(value: str) -> str:
    """Whole amounts only."""
    return above(value, ("NULL", "No data"), ("10000", "under 10,000"), ("15000", "10,001~15,000"), ("20000", "15,001~20,000"),
                 ("30000", "20,001~30,000"), ("50000", "30,001~50,000"), last="over 50,001")


def oo_value(value: str) -> str:
    return above(value, ("NULL", "No data"), ("10000", "under 10k"), ("20000", "10k~20k"), ("30000", "20k~30k"), ("50000", "30k~50k"),
                 ("100000", "50k~100k"), ("1000000", "100k~1m"), last="over 1m")


def cross_sell(value: str) -> str:
    """Means between the end of a band and the whole number after it have no band."""
    gap = " OR ".join(f"({value} > {edge} AND {value} < {edge} + 1)" for edge in (10000, 50000, 100000, 500000))
    bands = above(value, ("10000", "under 10,000"), ("50000", "10,001~50,000"), ("100000", "50,001~100,000"), ("500000", "100,001~500,000"), ("1000000", "500,001~1,000,000"), last="rg_only_donor")
    return f"CASE WHEN {value} IS NULL OR {gap} THEN 'rg_only_donor' ELSE {bands} END"


def quarter_tenure(months: str) -> str:
    return f"CASE WHEN {months} BETWEEN 0 AND 12 THEN (['0M~3M', '0M~3M', '0M~3M', '0M~3M', '4M~6M', '4M~6M', '4M~6M', '7M~9M', '7M~9M', '7M~9M', '10M~12M', '10M~12M', '10M~12M'])[{months} + 1] ELSE '' END"


def year_tenure(months: str) -> str:
    return f"if({months} >= 0 AND {months} < 13, '1YR', '')"


def gift_gap(days: str) -> str:
    """Whole days, NULL without an earlier gift."""
    return f"CASE WHEN {days} IS NULL OR {days} < 0 THEN 'No TSER donor' ELSE {above(days, ('0', 'None'), ('364', 'less than 1yr'), ('729', '1yr'), ('1097', '2yrs'), last='Over 3yrs')} END"


def value_order(label: str) -> str:
    return f"CAST(coalesce(map {{'under 10k': 1, '10k~20k': 2, '20k~30k': 3, '30k~50k': 4, '50k~100k': 5, '100k~1m': 6, 'over 1m': 7}}[{label}], 999) AS INTEGER)"


def age_order(label: str) -> str:
    return f"CAST(coalesce(map {{'under 18': 1, '19~25': 2, '26~30': 3, '31~40': 4, '41~50': 5, '51~60': 6, 'over 61': 7, 'No data': 8}}[{label}], 999) AS INTEGER)"


def life_year_order(label: str) -> str:
    return f"CAST(coalesce(map {{'New Active': 1, 'Over 1yr': 2, 'Over 2yrs': 3, 'Over 3yrs': 4, 'Over 4yrs': 5}}[{label}], 999) AS INTEGER)"


def region_order(label: str) -> str:
    return f"CAST(coalesce(map {{'Seoul Metropolitan Area': 1, 'Urban Cities': 2, 'Other Provinces': 3, 'No data': 4}}[{label}], 999) AS INTEGER)"
