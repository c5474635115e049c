from datetime import date

import pytest

from retenta import Period
from retenta.operators import RunFolder
from retenta.plans import commitments as com
from retenta.plans import retention as ret

JUNE = Period.month(2026, 6)
CHANNELS = [
    {"channel_t": "ab", "acq_gb": "Existing", "channel_excl_upgrade": "F2F SW A", "channel": "F2F", "new_site_code_acq": "1.1 F2F"},
    {"channel_t": "re", "acq_gb": "Existing", "channel_excl_upgrade": "UP_X", "channel": "TM", "new_site_code_acq": "1.3 Reactivation"},
    {"channel_t": "co", "acq_gb": "Existing", "channel_excl_upgrade": "Conv", "channel": "TM", "new_site_code_acq": "2.6 Conversion"},
    {"channel_t": "up", "acq_gb": "Existing", "channel_excl_upgrade": "UPGRADE", "channel": "TM", "new_site_code_acq": "2.5 Upgrade"},
    {"channel_t": "no", "acq_gb": "Existing", "channel_excl_upgrade": "DRTV", "channel": "DRTV"},
]
GOOD = {"pledge_uid": 1, "donor_no": 1, "submit_date": date(2026, 6, 10), "start_month": "2026-06", "payment_method": "CMS",
        "campaign_raw": "a/b/1"}


def flags(table, pledge=None, contact=None):
    pledges = table("pledges", {**GOOD, **(pledge or {})})
    contacts = table("contacts", {"donor_no": 1, "name": "kim", **(contact or {})})
    base = com.classified_pledges(com.commitment_core(pledges, contacts), table("channel_gb", *CHANNELS))
    row = ret.donor_flags(base, JUNE).collect()[0]
    return row.active_donor + row.new_donor + row.reactivation + row.conversion


@pytest.mark.parametrize(
    ("pledge", "contact", "expected"),
    [
        ({}, {}, "yynn"),
        ({"submit_date": date(2026, 5, 31)}, {}, "ynnn"),
        ({"submit_date": date(2026, 7, 1)}, {}, "nnnn"),
        ({"submit_date": None}, {}, "ynnn"),
        ({}, {"all_end_date": date(2026, 6, 30)}, "nnnn"),
        ({}, {"all_end_date": date(2026, 7, 1)}, "yynn"),
        ({"campaign_raw": None}, {}, "nnnn"),
        ({"cancel_cal_date": "2026-06-30"}, {}, "nnnn"),
        ({"cancel_cal_date": "2026-07-01"}, {}, "yynn"),
        ({"payment_method": "무통장입금"}, {}, "nnnn"),
        ({"payment_method": None}, {}, "nnnn"),
        ({"start_month": None}, {}, "nnnn"),
        ({"end_month": "2026-06"}, {}, "nnnn"),
        ({"end_month": "2026-07"}, {}, "yynn"),
        ({"user_type2": "기타"}, {}, "nnnn"),
        ({"campaign_raw": "u/p"}, {}, "nnnn"),
        ({"campaign_raw": "r/e"}, {}, "nnyn"),  # no channel exclusion for reactivations
        ({"campaign_raw": "c/o"}, {}, "ynny"),
        ({"campaign_raw": "n/o"}, {}, "ynnn"),  # no site code: not new, but active
        ({"campaign_raw": "x/y"}, {}, "nnnn"),  # unknown channel
    ],
)
def test_flags(table, pledge, contact, expected):
    assert flags(table, pledge, contact) == expected


def cancelled(table, *contacts):
    base = {"cancel_date": date(2026, 6, 15), "all_end_date": date(2026, 6, 20), "cancel_route": "전화", "payment_method": "CMS",
            "name": "kim", "contact_date": date(2026, 4, 30), "cancel_reason": "이사"}
    return ret.cancelled_contacts(table("contacts", *[{**base, **c} for c in contacts]), JUNE)


def test_cancelled_contacts(table):
    frame = cancelled(
        table, {"donor_no": 1}, {"donor_no": 2, "cancel_date": date(2026, 7, 1)}, {"donor_no": 3, "all_end_date": date(2026, 7, 1)},
        {"donor_no": 4, "all_end_date": None}, {"donor_no": 5, "cancel_route": "후원자관리팀"}, {"donor_no": 6, "cancel_route": None},
        {"donor_no": 7, "payment_method": "무통장입금"}, {"donor_no": 8, "name": "삭제 kim"}, {"donor_no": 9, "name": None},
        {"donor_no": 10, "all_end_date": date(2026, 5, 1)},
    )
    assert sorted(r.donor_no for r in frame.collect()) == [1, 10]


def test_cancelled_pledges_numbers_and_bands(table):
    pledges = table(
        "pledges",
        {"pledge_uid": 1, "donor_no": 1, "campaign_raw": "a/b", "submit_date": date(2026, 5, 1)},
        {"pledge_uid": 2, "donor_no": 1, "campaign_raw": "c/o", "submit_date": date(2025, 5, 1)},
        {"pledge_uid": 3, "donor_no": 1, "campaign_raw": "UPGRADE/x", "submit_date": date(2024, 5, 1)},
        {"pledge_uid": 4, "donor_no": 1, "submit_date": date(2024, 5, 1)},
        {"pledge_uid": 5, "donor_no": 2, "campaign_raw": "a/b"}, {"pledge_uid": 6, "donor_no": 3, "campaign_raw": "a/b"},
    )
    frame = ret.cancelled_pledges(
        pledges, cancelled(table, {"donor_no": 1}, {"donor_no": 2, "cancel_reason": "장기미납 3M"}, {"donor_no": 3, "cancel_reason": None}),
        stage=RunFolder.of_session(pledges.sparkSession),
    )
    rows = sorted(frame.collect(), key=lambda r: r.pledge_nm)
    assert [(r.channel_t, r.pledge_nm, r.lifetime, r.cancel_month, r.ltm_band, r.lty_band) for r in rows] == [
        ("co", 1, 2, "2606", "0M~3M", "1YR"), ("ab", 2, 2, "2606", "0M~3M", "1YR")]


def test_only_the_first_pledge_can_lapse(table):
    pledges = table(
        "pledges",
        {"pledge_uid": 1, "donor_no": 1, "campaign_raw": "a/b", "submit_date": date(2026, 5, 1)},
        {"pledge_uid": 2, "donor_no": 1, "campaign_raw": "c/o", "submit_date": date(2025, 5, 1)},
        {"pledge_uid": 3, "donor_no": 2, "campaign_raw": "a/b", "submit_date": date(2025, 5, 1)},
        {"pledge_uid": 4, "donor_no": 3, "campaign_raw": "n/o", "submit_date": date(2025, 5, 1)},
    )
    gone = cancelled(table, {"donor_no": 1}, {"donor_no": 2, "contact_date": date(2025, 1, 1)}, {"donor_no": 3})
    lapsed = ret.lapsed_flags(ret.lapsed_donors(pledges, gone, table("channel_gb", *CHANNELS)), JUNE).collect()
    # Donor 1 lapses under an excluded site code, donor 3 under none.
    assert [(r.donor_no, r.lapsed, r.lapsed_3m, r.lapsed_12m) for r in lapsed] == [(2, "y", "n", "n")]


KEYS = "review_month date, channel_sitecode string, channel_gb string, recruit_channel string, f2f_type_street_b2b string, f2f_channel_gb string"


def test_summary_full_join(spark):
    m = JUNE.start
    donors = spark.createDataFrame(
        [(m, "1", "a", "r", "t", "f", 1, 2, 3, 4), (m, None, "a", "r", "t", "f", 1, 0, 0, 0), (m, "3", "a", "r", "t", "f", 0, 0, 0, 0),
         (m, "4", "a", "r", "t", "f", 0, 5, 0, 0)],
        KEYS + ", new_donors bigint, active_donors bigint, reactivation_donors bigint, conversion_donors bigint")
    lapsed = spark.createDataFrame(
        [(m, "1", "a", "r", "t", "f", 7, 8, 9), (m, None, "a", "r", "t", "f", 6, 0, 0), (m, "5", "a", "r", "t", "f", 2, 0, 1)],
        KEYS + ", lapsed_donors bigint, lapsed_donors_3m bigint, lapsed_donors_12m bigint")
    rows = [(r.period, r.channel_sitecode, r.new_donor, r.active_donor, r.lapsed_donor, r.lapsed_12m, r.conversion_donor)
            for r in ret.retention_summary(donors, lapsed).collect()]
    assert [r[1] for r in rows] == [None, None, "1", "4", "5"]
    assert set(rows) == {
        ("2026-06", None, 1, 0, None, None, 0), (None, None, None, None, 6, 0, None), ("2026-06", "1", 1, 2, 7, 9, 4),
        ("2026-06", "4", 0, 5, None, None, 0), (None, "5", None, None, 2, 1, None)}
    filled = ret.retention_summary(donors, lapsed, coalesce_period=True).collect()
    assert {r.period for r in filled} == {"2026-06"}


def test_crosstab_counts_rows_and_donors(table, spark):
    donors = spark.createDataFrame([(1, "y", "n", "n", "n"), (1, "y", "n", "n", "n"), (2, "y", "n", "n", "n")],
                                   "supporter_id bigint, active_donor string, new_donor string, reactivation string, conversion string")
    lapsed = spark.createDataFrame([(2, "y", "n", "y")], "donor_no bigint, lapsed string, lapsed_3m string, lapsed_12m string")
    rows = ret.flag_crosstab(donors, lapsed).collect()
    assert {(r.lapsed, r.nmbr, r.dist_nmbr) for r in rows} == {(None, 2, 1), ("y", 1, 1)}
