"""Expected labels are written out by hand here, apart from the rule tables."""

from decimal import Decimal

import pytest

from retenta import vocab as v
from retenta.functions import band, classify, rank_map


def labels(values, rules, field, inputs, otherwise=None, keep=False):
    from pyspark.sql import functions as F  # noqa: F401

    return values("x string", inputs, lambda c: classify(rules, {field: c}, c if keep else otherwise))


def test_first_rule_wins_and_null_falls_through(values):
    got = labels(values, v.PLEDGE_STATUS, "pledge_status", ["종료", "진행", "일시중지", "대기", "else", None])
    assert got == ["end", "progress", "pause", "?", None, None]


def test_enrol_type(values):
    got = labels(values, v.ENROL_TYPE, "enroll", ["개인", "기업/단체", "외국인", "기타", None])
    assert got == ["Individual", "Group", "Foreigner", None, None]


def test_cancel_route(values):
    rules = v.Vocabulary(own_name="Fund").cancel_route
    routes = [("홈페이지", ""), ("전화", ""), ("콜센터 OUT", ""), ("우편", ""), ("이메일", ""), ("방문", ""), (None, ""),
              ("후원자관리팀", "이사"), ("후원자관리팀", "장기미납 3M"), ("후원자관리팀", None)]
    got = values("r string, w string", routes, lambda r, w: classify(rules, {"cancel_route": r, "cancel_reason": w}, "ERROR"))
    assert got == ["Fund Website", "Donorcare line", "Donorcare line", "Email/Mail", "Email/Mail", "ERROR", "Donorcare line",
                   "No data", "ERROR", "ERROR"]


CHANNELS = ["F2F APPCO X", "F2F SW B2B", "F2F DN 1", "F2F KDA", "F2F LW", "F2F OM", "F2F PN", "F2F GW", "F2F IH", "DRTV", None]


def test_recruit_channel(values):
    assert labels(values, v.RECRUIT_CHANNEL, "channel", CHANNELS, keep=True) == [
        "F2F SW", "F2F SW", "F2F DN", "F2F KDA", "F2F LW", "F2F OM", "F2F PN", "F2F GW", "F2F IH", "DRTV", None]


def test_f2f_type(values):
    inputs = ["F2F SW B2B", "F2F SW", "F2F B2B x", "X B2B", "DRTV", None]
    assert labels(values, v.F2F_TYPE, "channel", inputs, "Other") == ["B2B", "Street", "Street", "B2B", "Other", "Other"]


def test_f2f_detail_keeps_the_channel(values):
    assert labels(values, v.F2F_DETAIL, "channel", CHANNELS, "Not F2F") == [*CHANNELS[:9], "Not F2F", "Not F2F"]


def test_rg_channel_groups(values):
    inputs = ["F2F SW B2B", "F2F SW", "F2FXSW 1", "F2F_AGENCY", "F2F IH", "ONLINE", "HopeTV", "Multi_SMS", "MAIL", "DRRD",
              "Multi_DRTV", "MultiXDRTV", "DRTV", "TM", None]
    assert labels(values, v.RG_CHANNEL_G1, "channel_t", inputs, keep=True) == [
        "F2F TOTAL", "F2F TOTAL", "F2F TOTAL", "F2F TOTAL", "F2F TOTAL", "Online", "HopeTV", "Multi_Digital/SMS",
        "HCR_COMP/MAIL/OTHER", "DRRD", "DRTV_SMS/Multi_MAIL/NEWSPAPER/Magazine", "MultiXDRTV", "DRTV", "TM", None]
    assert labels(values, v.RG_CHANNEL_G2, "channel_t", inputs, keep=True) == [
        "F2F AGENCY", "F2F AGENCY", "F2FXSW 1", "F2F AGENCY", "F2F IH", "ONLINE", "ONLINE", "ONLINE", "Others", "DRTV",
        "DRTV", "MultiXDRTV", "DRTV", "TM", None]
    rest = ["Not F2F Agency"] * 10
    assert labels(values, v.RG_CHANNEL_G3, "channel_t", inputs, v.RG_CHANNEL_G3_DEFAULT) == [
        "F2F SW_B2B", "F2F SW_Street", "F2F SW_Street", "F2F AGENCY", "F2F IH", *rest]
    assert labels(values, v.RG_CHANNEL_G4, "channel_t", inputs, keep=True)[:6] == [
        "F2F SW", "F2F SW", "F2F SW", "F2F_AGENCY", "F2F IH", "ONLINE"]


def test_oo_channel_groups(values):
    inputs = ["F2FSW1", "F2FIH", "Campaign1", "ONLINE", "DRTV", "DRRD", "Multi_SMS", "MAILWITHU", "PPHHNWI", "TM", None]
    assert labels(values, v.OO_CHANNEL_GB1, "channel_f", inputs, keep=True) == [
        "F2F TOTAL", "F2F TOTAL", "ONLINE", "ONLINE", "DRTV", "DRRD", "Multi_Digital/SMS", "HCR_COMP/MAIL/OTHER", "PPH", "TM", None]
    assert labels(values, v.OO_CHANNEL_GB2, "channel_f", inputs, keep=True) == [
        "F2F AGENCY", "F2F IH", "ONLINE_T", "ONLINE_T", "DRTV_T", "DRTV_T", "ONLINE_T", "HCR_COMP/MAIL/OTHER", "PPH_T", "TM", None]


def test_oo_third_group_reads_both_codes(values):
    pairs = [("F2FSWA", "x"), ("F2FSWB2B", "F2FSWB2B"), ("F2FSWB2B", "x"), ("F2FDN1", "x"), ("Q", "PPHCORP"), ("Q", "DRRD"),
             ("Q", "MAIL"), ("Q", "Campaign1"), ("Q", "TM"), (None, None)]
    got = values("t string, f string", pairs, lambda t, f: classify(v.OO_CHANNEL_GB3, {"channel_t": t, "channel_f": f}, f))
    assert got == ["F2F SW_T", "F2F SW_B2B_T", "x", "F2F DN_T", "PPH_T", "DRTV_T", "HCR_COMP/MAIL/OTHER", "ONLINE_T", "TM", None]


def test_oo_short_channel(values):
    inputs = ["DRTV_T", "Multi_Channel_T", "HCR_COMP/MAIL/OTHER", "HOPETV", "ONLINE_T", "PPH_T", "F2F AGENCY", "F2F_AGENCY", "F2F IH"]
    assert labels(values, v.OO_CHANNEL_SHORT, "channel_gb2", inputs, keep=True) == [
        "DRTV", "Multi_Channel", "Others", "Others", "ONLINE", "PPH", "F2F AGENCY", "F2F AGENCY", "F2F IH"]


def test_regions(values):
    inputs = ["서울특별시", "인천광역시", "대구광역시", "경상북도", "울산광역시", "경상남도", "광주광역시", "전라북도", "대전광역시",
              "세종특별자치시", "강원도", "제주특별자치도", "NA", "", None]
    assert labels(values, v.REGION_GROUPS, "region", inputs, "No data") == [
        "서울,경기,인천", "서울,경기,인천", "대구,경북", "대구,경북", "부산,울산,경남", "부산,울산,경남", "광주,전라", "광주,전라",
        "대전,충청,세종", "대전,충청,세종", "강원", "제주", "No data", "No data", "No data"]
    s, u, o, n = "Seoul Metropolitan Area", "Urban Cities", "Other Provinces", "No data"
    assert labels(values, v.REGION_CLASSES, "region", inputs, "No data") == [s, s, u, o, u, o, u, o, u, o, o, o, n, n, n]


def test_cash_type(values):
    inputs = ["X Cash_SMS 1", "Cash_DM/1", "Cash_EMAIL", "Cash_MULTI", "Cash_OTHER", "CashXSMS", "Cash_SMS Cash_DM", None]
    assert labels(values, v.CASH_TYPE, "campaign", inputs) == [
        "Cash_SMS", "Cash_DM", "Cash_EMAIL", "Cash_MULTI", None, "Cash_SMS", "Cash_SMS", None]


def test_earmark(values):
    inputs = ["Earthquakes in Türkiye and Syria", "Syria Emergency", "Ukraine Emergency", "Unearmarked Donations",
              "Global Shelter Campaign", "Sudan Emergency 1", "Water", None]
    assert labels(values, v.EARMARK, "d_sec_eng", inputs, v.EARMARK_DEFAULT) == [
        "TS ER", "SYR ER", "UKR ER", "Unearmarked", "Global Shelter", "Other ER", "General", "General"]


def test_collector_route(values):
    inputs = ["고객해지(PayInfo-고객)", "고객해지(PayInfo-금융기관)", "고객해지(금융기관)", "기타", None]
    assert labels(values, v.COLLECTOR_ROUTE, "result_kind", inputs, "Bank") == ["PayInfo", "PayInfo", "Bank", "Bank", "Bank"]


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (("취소입금", 0.0, "a", "CMS 공동", "x"), "제외"), (("입금", 5.0, "카카오", "이체", "x"), "제외"),
        (("입금", 0.0, "이자세금1", "이체", "x"), "제외"), (("입금", 0.0, "Fund", "이체", "x"), "제외"),
        (("입금", 0.0, "공인인증서발급수수료9", "이체", "x"), "제외"), (("입금", 0.0, "카카오", "CMS 공동", "x"), "CMS"),
        (("입금", 0.0, "NICE페이먼츠(", "이체", "x"), "PG"), (("입금", 0.0, "지로입금", "이체", "x"), "지로"),
        (("입금", 0.0, "해피빈01", "이체", "x"), "해피빈"), (("입금", 0.0, "카카오", "이체", "x"), "카카오스토리펀딩"),
        (("입금", 0.0, "네이버페이2", "이체", "x"), "네이버페이"), (("입금", 0.0, "카카오페이2", "이체", "x"), "카카오페이"),
        (("입금", 0.0, "KT02", "이체", "x"), "KT"), (("입금", 0.0, "신한법인1", "이체", "x"), "신한카드 포인트"),
        (("입금", 0.0, "신한카드자금", "이체", "x"), "신한카드 포인트"), (("입금", 0.0, "하나91", "이체", "하나은행"), "하나카드 포인트"),
        (("입금", 0.0, "하나91", "이체", "국민은행"), ""), (("입금", 0.0, "1국민카드", "이체", "x"), "KB카드 포인트"),
        (("입금", 0.0, "1 KB 포", "이체", "x"), "KB카드 포인트"), (("입금", 0.0, "A/UK1", "이체", "x"), "베네비티"),
        (("입금", None, None, None, None), ""), ((None, None, None, "CMS 공동", None), "CMS"),
    ],
)
def test_bank_ledger(values, row, expected):
    rules = v.Vocabulary(own_name="Fund").bank_ledger
    got = values(
        "gb string, s double, n string, m string, b string", [row],
        lambda gb, s, n, m, b: classify(rules, {"gb": gb, "spend_out": s, "name": n, "tran_method": m, "bank": b}, ""),
    )
    assert got == [expected]


def test_age_bands(values):
    ages = [-1, 0, 1, 18, 19, 25, 26, 30, 31, 40, 41, 50, 51, 60, 61, None]
    n = "No data"
    assert values("a int", ages, lambda c: band(c, v.RG_AGE_BANDS, n)) == [
        n, n, "under 18", "under 18", "19~25", "19~25", "26~30", "26~30", "31~40", "31~40", "41~50", "41~50", "51~60",
        "51~60", "over 61", n]
    assert values("a int", ages, lambda c: band(c, v.OO_AGE_BANDS, n))[:4] == ["under 18"] * 4
    assert values("a int", [60, 61, None], lambda c: band(c, v.OO_AGE_BANDS, n)) == ["51~60", "over 61", n]


def test_amount_bands(values):
    edges = [0, 10000, 10001, 15000, 15001, 20000, 20001, 30000, 30001, 50000, 50001, None]
    assert values("a bigint", edges, lambda c: band(c, v.RG_GIFT_BANDS, "No data")) == [
        "under 10,000", "under 10,000", "10,001~15,000", "10,001~15,000", "15,001~20,000", "15,001~20,000",
        "20,001~30,000", "20,001~30,000", "30,001~50,000", "30,001~50,000", "over 50,001", "No data"]
    amounts = ["10000", "10000.5", "20000", "20001", "30000", "50000", "100000", "1000000", "1000000.1"]
    assert values("a decimal(18,1)", [*map(Decimal, amounts), None], lambda c: band(c, v.OO_VALUE_BANDS, "No data")) == [
        "under 10k", "10k~20k", "10k~20k", "20k~30k", "20k~30k", "30k~50k", "50k~100k", "100k~1m", "over 1m", "No data"]


def test_mean_between_whole_number_bands_takes_the_default(values):
    means = [*map(Decimal, ["10000", "10000.5", "10001", "50000.5", "1000000"]), None]
    got = values("a decimal(18,1)", means, lambda c: band(c, v.CROSS_SELL_BANDS, v.CROSS_SELL_DEFAULT))
    assert got == ["under 10,000", "rg_only_donor", "10,001~50,000", "rg_only_donor", "500,001~1,000,000", "rg_only_donor"]


def test_gap_and_tenure_bands(values):
    days = [0, 1, 364, 365, 729, 730, 1097, 1098, None]
    assert values("a int", days, lambda c: band(c, v.GIFT_GAP_BANDS)) == [
        "None", "less than 1yr", "less than 1yr", "1yr", "1yr", "2yrs", "2yrs", "Over 3yrs", None]
    months = [-1, 0, 3, 4, 6, 7, 9, 10, 12, 13, None]
    assert values("a int", months, lambda c: band(c, v.TENURE_QUARTER_BANDS, "")) == [
        "", "0M~3M", "0M~3M", "4M~6M", "4M~6M", "7M~9M", "7M~9M", "10M~12M", "10M~12M", "", ""]
    assert values("a int", months, lambda c: band(c, v.TENURE_YEAR_BANDS, "")) == ["", *["1YR"] * 8, "", ""]


def test_report_orders(values):
    assert values("x string", ["under 10k", "over 1m", "No data", None], lambda c: rank_map(c, v.OO_VALUE_ORDER)) == [1, 7, 999, 999]
    assert values("x string", ["under 18", "No data", "?"], lambda c: rank_map(c, v.AGE_ORDER)) == [1, 8, 999]
    assert values("x string", ["New Active", "Over 4yrs"], lambda c: rank_map(c, v.LIFE_YEAR_ORDER)) == [1, 5]
    assert values("x string", ["Seoul Metropolitan Area", "No data"], lambda c: rank_map(c, v.REGION_ORDER)) == [1, 4]
