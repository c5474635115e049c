from datetime import date, datetime
from decimal import Decimal

import pytest

from retenta import Period
from retenta.operators import RunFolder
from retenta.plans import commitments as com

JUNE = Period.month(2026, 6)
AS_OF = date(2026, 7, 1)


def money(x):
    return Decimal(x).quantize(Decimal("0.01"))


def view(table, pledges, gifts=(), contacts=({"donor_no": 1, "name": "a"},), campaigns=()):
    frame = com.commitment_view(
        table("pledges", *pledges), table("transactions", *gifts), table("contacts", *contacts),
        table("campaigns", *campaigns), AS_OF, datetime(2026, 7, 1, 6),
    )
    return {r.commitment_id: r for r in frame.collect()}


def gift(uid, pledge, day, amount):
    return {"tran_uid": uid, "pledge_uid": pledge, "send_date": day, "tran_amount": money(amount)}


def test_first_and_last_gift_by_date_then_id(table):
    rows = view(
        table, [{"pledge_uid": 1, "donor_no": 1}, {"pledge_uid": 2, "donor_no": 1}],
        [gift("b", 1, date(2026, 1, 5), 20), gift("a", 1, date(2026, 1, 5), 10), gift("c", 1, date(2026, 3, 5), 30),
         gift("d", 1, date(2026, 3, 5), 40), gift("z", None, date(2020, 1, 1), 99)],
    )
    assert (rows[1].original_commitment_amount, rows[1].commitment_amount) == (money(10), money(40))
    assert (rows[2].original_commitment_amount, rows[2].commitment_amount) == (None, None)


def test_undated_gift_is_first_and_never_last(table):
    rows = view(table, [{"pledge_uid": 1, "donor_no": 1}],
                [gift("a", 1, date(2026, 1, 5), 10), gift("z", 1, None, 70)])
    assert (rows[1].original_commitment_amount, rows[1].commitment_amount) == (money(70), money(10))


@pytest.mark.parametrize(
    ("frequency", "end", "last", "expected"),
    [
        (1, date(2026, 2, 2), date(2020, 1, 1), date(2026, 2, 2)),
        (1, None, date(2026, 4, 1), None),
        (1, None, date(2026, 3, 31), date(2026, 6, 30)),
        (12, None, date(2025, 6, 1), None),
        (12, None, date(2025, 5, 31), date(2026, 6, 30)),
        (6, None, date(2020, 1, 1), None),
        (None, None, date(2020, 1, 1), None),
        (1, None, None, None),
    ],
)
def test_commitment_end(table, frequency, end, last, expected):
    pledge = {"pledge_uid": 1, "donor_no": 1, "frequency": frequency, "end_date": end}
    gifts = [gift("a", 1, last, 5)] if last else []
    assert view(table, [pledge], gifts)[1].commitment_end_date == expected


def test_one_off_pledges_are_left_out_and_missing_type_kept(table):
    rows = view(table, [{"pledge_uid": 1, "user_type2": "수시"}, {"pledge_uid": 2, "user_type2": "기타"}, {"pledge_uid": 3}])
    assert set(rows) == {2, 3}


def test_frequency_labels_and_lookup(table):
    rows = view(
        table,
        [{"pledge_uid": i, "donor_no": 1, "frequency": f, "campaign_raw": c}
         for i, f, c in ((1, 1, "a/b"), (2, 12, None), (3, None, "x"), (4, 3, "a/b"))],
        campaigns=[{"campaign_raw": "a/b", "campaign": "text"}],
    )
    assert [rows[i].commitment_frequency for i in (1, 2, 3, 4)] == ["Monthly", "Annual", "check", "Other"]
    assert [rows[i].commitment_description for i in (1, 2, 3, 4)] == ["text", None, None, "text"]
    assert len(rows[1]) == 39


def test_pledge_checks(table):
    frame = table(
        "pledges",
        {"pledge_uid": 1, "submit_date": date(2026, 6, 30), "name": "kim"},
        {"pledge_uid": 2, "submit_date": date(2026, 6, 1), "name": "a test b"},
        {"pledge_uid": 3, "submit_date": date(2026, 6, 1)},
        {"pledge_uid": 4, "submit_date": date(2026, 7, 1), "name": "kim"},
        {"pledge_uid": 5, "submit_date": date(2026, 6, 2), "name": "kim", "campaign_raw": "F2F/IH/A"},
        {"pledge_uid": 6, "submit_date": date(2026, 6, 2), "name": "kim", "campaign_raw": "F2FIH/Reactivation"},
    )
    assert [r.pledge_uid for r in com.missing_campaign(frame, JUNE).collect()] == [1]
    assert [r.pledge_uid for r in com.inhouse_unmarked(frame, JUNE).collect()] == [5]


def test_pledge_numbers_with_ties_and_missing_values(table):
    days = [date(2026, 1, 1), None, date(2025, 1, 1), date(2026, 1, 1), date(2026, 1, 1)]
    months = ["2026-02", None, "2025-01", "2026-01", "2026-02"]
    pledges = table("pledges", *[
        {"pledge_uid": 10 - i, "donor_no": 1, "submit_date": d, "start_month": m} for i, (d, m) in enumerate(zip(days, months))
    ], {"pledge_uid": 99, "donor_no": 2, "submit_date": days[0]})
    contacts = table("contacts", {"donor_no": 1, "name": "kim"}, {"donor_no": 2, "name": "lee"})
    base = com.pledge_base(com.commitment_core(pledges, contacts), table("channel_gb"), stage=RunFolder.of_session(pledges.sparkSession))
    assert {r.commitment_id: r.pledge_nm for r in base.collect()} == {9: 1, 8: 2, 7: 3, 6: 4, 10: 5, 99: 1}


def test_base_drops_test_and_nameless_donors_and_uses_existing_channel(table):
    pledges = table("pledges", *[{"pledge_uid": i, "donor_no": i, "campaign_raw": "a/b/c", "status": s}
                                 for i, s in ((1, "3"), (2, "1"), (3, None))])
    contacts = table("contacts", {"donor_no": 1, "name": "kim"}, {"donor_no": 2, "name": "TEST kim"}, {"donor_no": 3})
    channels = table("channel_gb", {"channel_t": "ab", "acq_gb": "Acquisition", "channel_excl_upgrade": "no"},
                     {"channel_t": "ab", "acq_gb": "Existing", "channel_excl_upgrade": "yes"})
    rows = com.pledge_base(com.commitment_core(pledges, contacts), channels, stage=RunFolder.of_session(pledges.sparkSession)).collect()
    assert [(r.commitment_id, r.channel, r.cancel_status) for r in rows] == [(1, "yes", "Y")]
    assert rows[0].asDict().keys() == set(com.PLEDGE_BASE_COLUMNS)
