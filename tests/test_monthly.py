from datetime import date, datetime

from retenta import Period, Vocabulary
from retenta.plans import monthly as mon

JUNE = Period.month(2026, 6)


def test_oneoff_counts(table):
    base = {"payment_type": "수시", "pledge_active": "N", "send_date": date(2026, 6, 30), "donation_section": "a"}
    gifts = table("transactions", *[{**base, "donor_no": d, **c} for d, c in (
        (1, {}), (1, {"donation_section": "b"}), (2, {}), (3, {"pledge_active": "Y"}), (4, {"payment_type": "정기"}),
        (5, {"send_date": date(2026, 7, 1)}), (None, {}))])
    assert mon.oneoff_headcount(gifts, JUNE).collect()[0].oo_donor == 2
    assert [tuple(r) for r in mon.oneoff_by_section(gifts, JUNE).collect()] == [("a", 2), ("b", 1)]


def test_email_subscribers(table):
    rows = [("Y", "Y", date(2026, 6, 30)), ("Y", "Y", date(2026, 7, 1)), ("N", "Y", date(2020, 1, 1)), ("Y", None, date(2020, 1, 1))]
    contacts = table("contacts", *[{"email_opt": a, "email_yn": b, "contact_date": d} for a, b, d in rows])
    assert mon.email_subscribers(contacts, JUNE).collect()[0].subscribers == 1


def test_external_cancellations_keep_every_result(table):
    at = datetime(2026, 6, 30, 23, 59)
    changes = table("change_history", *[
        {"member_no": m, "field": f, "before_value": "Y", "changed_by": "SCMS", "changed_at": t}
        for m, f, t in ((1, "납부여부", at), (1, "납부여부", at), (2, "납부여부", at), (3, "주소", at), (4, "납부여부", datetime(2026, 7, 1)),
                        (5, "납부여부", at))])
    results = table("cms_results", *[
        {"member_no": m, "applied_on": d, "external_approval": "Y", "apply_kind": "해지", "result_kind": k}
        for m, d, k in ((1, date(2026, 5, 31), "고객해지(PayInfo-고객)"), (1, date(2026, 6, 29), "고객해지(금융기관)"),
                        (2, date(2026, 6, 30), "고객해지(PayInfo-고객)"))])
    members = table("crm_contacts", *[{"member_no": m, "pay_active": a, "pay_end_date": d} for m, a, d in (
        (1, "N", date(2026, 6, 3)), (2, "N", None), (3, "N", None), (4, "N", None), (5, "Y", None))])
    rows = mon.external_cancel_by_route(changes, results, members, JUNE).collect()
    assert [tuple(r) for r in rows] == [("Bank", None, 1), ("Bank", "2026-06", 1), ("PayInfo", "2026-06", 1)]


def test_bank_income_and_anonymous(table):
    vocab = Vocabulary(own_name="Fund")
    ledger = table("bank_ledger", *[{"gb": "입금", "name": n, "spend_out": 0.0, "tran_method": "이체", "report_ym": ym} for n, ym in (
        ("kim", "2606"), (None, "2606"), ("Fund", "2606"), ("KT021", "2606"), ("kim", "2605"))])
    gifts = table("transactions", {"donor_no": 1, "payment_method": "무통장입금", "income_date": date(2026, 6, 1)},
                  {"payment_method": "무통장입금", "income_date": date(2026, 6, 1)}, {"donor_no": 2, "payment_method": "CMS", "income_date": date(2026, 6, 1)})
    assert {tuple(r) for r in mon.bank_income_class(ledger, JUNE, vocab).collect()} == {("", 2), ("제외", 1), ("KT", 1)}
    assert tuple(mon.anonymous_oneoff(ledger, gifts, JUNE, vocab=vocab).collect()[0]) == (2, 1, 1)


def test_refunds_and_the_last_day(table):
    cases = table("case_log", *[
        {"case_id": i, "member_uid": u, "recorded_at": t, "category": c, "subcategory": s, "title": title}
        for i, u, t, c, s, title in (
            (1, 7, datetime(2026, 6, 30), "환불", "환불완료", "card_500_dup"), (2, 7, datetime(2026, 6, 30, 9), "환불", "환불완료", "x"),
            (3, 7, datetime(2026, 6, 1), "환불", "접수", "x"), (4, 8, datetime(2026, 6, 2), "환불", "환불완료", "x"),
            (5, 7, datetime(2026, 6, 1, 1), "환불", "환불완료", "a_b_c_d_e"))])
    members = table("crm_contacts", {"member_uid": 7, "member_no": 70})
    rows = mon.refund_list(cases, members, JUNE).collect()
    assert [(r.member_no, r.refund_method, r.refund_amount, r.refund_reason) for r in rows] == [
        (70, None, None, None), (70, "card", "500", "dup")]
    assert mon.refund_list(cases, members, JUNE, whole_last_day=True).count() == 3
