"""Supporter-shaped stand-ins for the source tables, derived from the generated test tables.

The SQL text runs unchanged in Spark and in DuckDB; Spark reads it over DataFrames, the oracle puts it in
front of its own queries as a WITH clause. ``{table}`` names a test table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from retenta.sources import TABLES, conform

BASE_TABLES = ("customer", "orders", "lineitem", "events", "documents")

STANDIN: dict[str, str] = {
    "contacts": """
        SELECT c_custkey AS donor_no,
          CASE WHEN c_custkey % 50 = 0 THEN 'Test ' || c_name WHEN c_custkey % 61 = 0 THEN NULL ELSE c_name END AS name,
          DATE '1996-01-01' + CAST(c_custkey % 1000 AS INT) AS contact_date,
          CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'RG' WHEN 1 THEN 'OO' END AS initial_enroll,
          CASE c_mktsegment WHEN 'BUILDING' THEN '기업/단체' WHEN 'MACHINERY' THEN '외국인'
            WHEN 'FURNITURE' THEN NULL ELSE '개인' END AS enroll,
          CASE WHEN c_custkey % 3 = 0 THEN 'F' WHEN c_custkey % 3 = 1 THEN 'M' END AS gender,
          CASE WHEN c_custkey % 17 <> 0 THEN CAST(1 + c_custkey % 79 AS INT) END AS age,
          CASE WHEN c_custkey % 17 <> 0 THEN DATE '1930-01-01' + CAST((c_custkey * 37) % 20000 AS INT) END AS birth_date,
          CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'CMS' WHEN 1 THEN '신용카드' WHEN 2 THEN 'NPay'
            WHEN 3 THEN 'KakaoPay' ELSE '무통장입금' END AS payment_method,
          CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-01' + CAST((c_custkey * 7) % 240 AS INT) END AS cancel_date,
          CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-01' + CAST((c_custkey * 7) % 240 + c_custkey % 40 AS INT) END
            AS all_end_date,
          CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '홈페이지' WHEN 1 THEN '전화' WHEN 2 THEN '이메일' WHEN 3 THEN '우편'
            WHEN 4 THEN '후원자관리팀' WHEN 5 THEN '콜센터 IN' END AS cancel_route,
          CASE WHEN c_custkey % 9 = 0 THEN '장기미납 3M' WHEN c_custkey % 23 = 0 THEN NULL ELSE '경제사정' END AS cancel_reason,
          CASE WHEN c_custkey % 6 = 0 THEN 'N' ELSE 'Y' END AS email_opt,
          CASE WHEN c_custkey % 4 = 0 THEN 'N' WHEN c_custkey % 4 = 1 THEN NULL ELSE 'Y' END AS email_yn,
          CASE WHEN c_custkey % 8 = 0 THEN '수신안함' END AS mail_opt,
          CASE WHEN c_custkey % 10 = 0 THEN 'MVD-PP' WHEN c_custkey % 10 = 1 THEN 'MVD-A' END AS mvd_type,
          CASE WHEN c_custkey % 11 = 0 THEN NULL
            WHEN c_custkey % 2 = 0 THEN CAST(100 + c_custkey % 700 AS VARCHAR(8)) || '-' || CAST(100 + c_custkey % 900 AS VARCHAR(8))
            ELSE CAST(1000 + (c_custkey * 37) % 62000 AS VARCHAR(8)) END AS home_zip,
          CASE WHEN c_custkey % 22 = 0 THEN '61' || CAST(100 + c_custkey % 900 AS VARCHAR(8)) END AS office_zip,
          CAST(CASE WHEN c_acctbal > 0 THEN c_acctbal * 8 ELSE 10000 END AS DECIMAL(18,2)) AS rg_amount,
          CAST(c_acctbal * 30 AS DECIMAL(18,2)) AS tot_amt,
          c_custkey % 37 AS tot_tran,
          CASE WHEN c_custkey % 13 <> 0
            THEN SUBSTRING(CAST(DATE '1994-01-01' + CAST(c_custkey % 2100 AS INT) AS VARCHAR(10)), 1, 7) END AS first_month,
          CASE WHEN c_custkey % 13 <> 0
            THEN SUBSTRING(CAST(DATE '1996-01-01' + CAST(c_custkey % 1400 AS INT) AS VARCHAR(10)), 1, 7) END AS start_month,
          CASE WHEN c_custkey % 5 = 0 THEN 'ONLINE//05' ELSE 'F2FDN/A/01' END AS campaign_raw
        FROM {customer}""",
    "pledges": """
        SELECT o_orderkey AS pledge_uid, o_custkey AS donor_no,
          CASE WHEN o_custkey % 50 = 0 THEN 'test pledge' WHEN o_custkey % 51 = 0 THEN NULL
            ELSE 'pledge of ' || CAST(o_custkey AS VARCHAR(20)) END AS name,
          CASE WHEN o_orderkey % 211 <> 0 THEN CAST(o_orderdate AS DATE) END AS submit_date,
          CASE WHEN o_orderkey % 23 <> 0 THEN SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) END AS start_month,
          CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 28 AS INT) END AS start_date,
          CASE WHEN o_orderkey % 5 = 0 THEN SUBSTRING(CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) AS VARCHAR(10)), 1, 7) END
            AS end_month,
          CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) END AS end_date,
          CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE 'N' END AS end_check,
          CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) END AS all_end_date,
          CASE WHEN o_orderkey % 19 = 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS VARCHAR(10)) END
            AS cancel_cal_date,
          CASE WHEN o_orderkey % 31 = 0 THEN '무통장입금' WHEN o_orderkey % 3 = 0 THEN '신용카드' WHEN o_orderkey % 3 = 1 THEN 'CMS'
            ELSE 'NPay' END AS payment_method,
          CASE WHEN o_orderkey % 2 = 0 THEN 'org A' ELSE 'org B' END AS org,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 12 WHEN o_orderpriority = '5-LOW' THEN NULL
            WHEN o_orderpriority = '2-HIGH' THEN 6 ELSE 1 END AS frequency,
          CASE WHEN o_orderkey % 4 = 0 THEN 'Syria Emergency' ELSE 'Unearmarked Donations' END AS donation_section,
          CASE WHEN o_orderkey % 6 = 0 THEN 'agency' END AS user_type1,
          CASE WHEN o_orderkey % 29 = 0 THEN '수시' WHEN o_orderkey % 37 = 0 THEN '기타' END AS user_type2,
          CASE WHEN o_orderkey % 8 = 0 THEN 'site ' || CAST(o_orderkey % 40 AS VARCHAR(8)) END AS user_input_1,
          CASE WHEN o_orderkey % 9 = 0 THEN 'web' ELSE 'desk' END AS entered,
          CASE CAST(o_orderkey % 13 AS INT) WHEN 0 THEN 'F2FSW/A/01' WHEN 1 THEN 'F2FSW/B2B/02' WHEN 2 THEN 'F2FDN/A/01'
            WHEN 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'F2FIH/A/Reactivation' ELSE 'F2F/IH/A/03' END
            WHEN 4 THEN 'ONLINE//05' WHEN 5 THEN 'DRTV//01' WHEN 6 THEN 'UPGRADE/TM/01'
            WHEN 7 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ONEOFF/X/01' ELSE 'UP_X/TM/01' END WHEN 8 THEN 'Reactivation/TM/01'
            WHEN 9 THEN 'CONVERSION/TM/02' WHEN 10 THEN 'PPHCORP/X/01'
            WHEN 11 THEN CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Cash_SMS' WHEN 1 THEN 'Cash_DM/1' WHEN 2 THEN 'Cash_EMAIL'
              WHEN 3 THEN 'X Cash_MULTI' ELSE 'Cash_OTHER' END
            WHEN 12 THEN CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'F2FSW/B2BEast/01' WHEN 1 THEN 'F2FAP/X/01' WHEN 2 THEN 'F2FKD/A/01'
              WHEN 3 THEN 'Multi/SMS/01' WHEN 4 THEN 'Multi/DRTV/01' END END AS campaign_raw,
          CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE 'Y' END AS pledge_active,
          CASE o_orderstatus WHEN 'F' THEN '3' WHEN 'O' THEN '1' ELSE '2' END AS status,
          CASE o_orderstatus WHEN 'F' THEN '종료' WHEN 'O' THEN '진행' ELSE '대기' END AS pledge_status,
          CAST(o_totalprice AS DECIMAL(18,2)) AS rg_amount
        FROM {orders}""",
    "transactions": """
        SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20))
            || '-' || CAST(l_suppkey AS VARCHAR(20)) AS tran_uid,
          CASE WHEN l_partkey % 101 <> 0 THEN l_orderkey END AS pledge_uid, p.donor_no,
          CASE WHEN l_partkey % 307 <> 0 THEN CAST(l_shipdate AS DATE) END AS send_date,
          CAST(l_shipdate AS DATE) + CAST(l_suppkey % 5 AS INT) AS income_date,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS tran_amount,
          CASE WHEN l_linestatus = 'F' THEN '정기' ELSE '수시' END AS payment_type,
          p.payment_method,
          CASE l_returnflag WHEN 'A' THEN 'Syria Emergency' WHEN 'N' THEN 'Unearmarked Donations' ELSE 'Other Emergency' END
            AS donation_section,
          p.pledge_active, p.campaign_raw AS campaign_id, l_partkey AS part_no, CAST(l_shipdate AS DATE) AS gift_date
        FROM {lineitem} l JOIN pledges p ON l_orderkey = p.pledge_uid""",
    "campaigns": """
        SELECT DISTINCT campaign_raw, 'campaign ' || campaign_raw AS campaign FROM pledges
        WHERE campaign_raw IS NOT NULL AND campaign_raw NOT LIKE 'DRTV%'""",
    "channel_gb": """
        SELECT * FROM (VALUES ('F2FSW','Existing','F2F SW','F2F','1.1 F2F'), ('F2FSWA','Existing','F2F SW A','F2F','1.1 F2F'),
          ('F2FSWB2B','Existing','F2F SW B2B','F2F','1.1 F2F'), ('F2FDNA','Existing','F2F DN A','F2F','1.1 F2F'),
          ('F2FSWB2BEast','Existing','F2F SW B2B East','F2F','1.1 F2F'), ('F2FAPX','Existing','F2F APPCO X','F2F','1.1 F2F'),
          ('F2FKDA','Existing','F2F KDA','F2F','1.1 F2F'), ('MultiSMS','Existing','Multi_SMS','Digital','1.2 Digital'),
          ('MultiDRTV','Existing','Multi_DRTV','DRTV','1.4 DRTV'),
          ('F2FIHA','Existing','F2F IH A','F2F','1.1 F2F'), ('F2FIH','Existing','F2F IH','F2F','1.1 F2F'),
          ('ONLINE','Existing','ONLINE','Digital','1.2 Digital'),
          ('DRTV','Existing','DRTV','DRTV','1.4 DRTV'), ('UPGRADETM','Existing','UPGRADE','TM','2.5 Upgrade'),
          ('UP_XTM','Existing','UP_X','TM','2.5 Upgrade'), ('ONEOFFX','Existing','ONEOFF','ONEOFF','2.1 Oneoff'),
          ('ReactivationTM','Existing','Reactivation','TM','1.3 Reactivation'),
          ('CONVERSIONTM','Existing','Conversion','TM','2.6 Conversion'), ('PPHCORPX','Existing','PPHCORP','PPH','5.1 Corporate'),
          ('Cash_DM1','Existing','Cash DM','Cash',NULL), ('F2FSWA','Acquisition','F2F SW A','F2F','1.1 F2F'))
          AS t(channel_t, acq_gb, channel_excl_upgrade, channel, new_site_code_acq)""",
    "classified_gifts": """
        SELECT tran_uid AS transaction_id, donor_no AS supporter_id,
          CASE WHEN payment_type = '정기' THEN 'Regular' ELSE 'Single' END AS transaction_type,
          gift_date AS transaction_date,
          CASE WHEN part_no % 53 = 0 THEN 'pphcorp/X' ELSE campaign_id END AS campaign_id,
          CASE WHEN campaign_id LIKE 'F2F%' THEN 'F2F' WHEN campaign_id LIKE 'ONLINE%' THEN 'ONLINE' ELSE 'OTHER' END AS channel,
          CASE WHEN part_no % 3 = 0 THEN 'Acquisition' WHEN part_no % 3 = 1 THEN 'Existing' WHEN part_no % 2 = 0 THEN 'Existing'
            ELSE 'Acquisition' END AS acq_gb_simple,
          CASE WHEN part_no % 97 = 0 THEN '2.%' WHEN part_no % 89 = 0 THEN NULL WHEN campaign_id LIKE 'F2F%' THEN '1.1 F2F'
            WHEN campaign_id LIKE 'ONLINE%' THEN '1.2 Digital' WHEN campaign_id LIKE 'CONVERSION%' THEN '2.6 Conversion'
            ELSE '9.9 Other' END AS sitecode
        FROM transactions""",
    "gift_facts": """
        SELECT tran_uid AS transaction_id, donor_no AS supporter_id, campaign_id,
          CASE WHEN part_no % 71 = 0 THEN NULL WHEN payment_type = '정기' THEN 'Regular' ELSE 'Single' END AS transaction_type,
          payment_method, gift_date AS transaction_date, CAST(NULL AS VARCHAR(7)) AS first_month, tran_amount AS transaction_amount,
          'cash' AS product, CAST(NULL AS VARCHAR(1)) AS mvd_income_auto
        FROM transactions""",
    "ltv_gifts": """
        SELECT t.donor_no AS supporter_id, 'donor ' || CAST(t.donor_no AS VARCHAR(20)) AS name, REPLACE(CAST(t.gift_date AS VARCHAR(10)), '-', '') AS transaction_date,
          CASE WHEN t.payment_type = '수시' THEN '1' ELSE '2' END AS payment_type,
          CASE WHEN t.part_no % 41 = 0 THEN NULL WHEN t.part_no % 37 = 0 THEN 'HappyBean' WHEN t.payment_method = '신용카드'
            THEN 'Credit Card' ELSE t.payment_method END AS payment_method,
          t.tran_amount AS transaction_amount, t.campaign_id AS source_id,
          CASE WHEN t.part_no % 29 = 0 THEN 'Special Gift' ELSE t.donation_section END AS donation_section,
          CASE WHEN t.donor_no % 13 <> 0
            THEN SUBSTRING(CAST(DATE '1994-01-01' + CAST(t.donor_no % 2100 AS INT) AS VARCHAR(10)), 1, 7) END AS first_month
        FROM transactions t""",
    "ltv_channel_gb": """
        SELECT * FROM (VALUES ('F2FSWA','F2FSWA','Acquisition'), ('F2FSWA','F2FSWA','Existing'), ('F2FSWB2B','F2FSWB2B','Acquisition'),
          ('F2FDNA','F2FDNA','Acquisition'), ('F2FIH','F2FIH','Acquisition'), ('ONLINE','ONLINE','Acquisition'),
          ('DRTV','DRTV','Acquisition'), ('UPGRADETM','UPGRADE','Existing'), ('PPHCORPX','PPHCORP','Acquisition'),
          ('ReactivationTM','MAILWITHU','Acquisition'), ('Cash_DM1','Multi_SMS','Acquisition'))
          AS t(channel_t, channel_f, acq_gb)""",
    "don_section": """
        SELECT * FROM (VALUES ('Syria Emergency','시리아','Syria Emergency'), ('Unearmarked Donations','일반','Unearmarked Donations'),
          ('Other Emergency','기타','Other Emergency Fund')) AS t(d_sec_raw, d_sec_kor, d_sec_eng)""",
    "zip_code_region": """
        SELECT * FROM (VALUES ('11','old_zip','서울특별시'), ('20','old_zip','경기도'), ('30','old_zip','대구광역시'),
          ('41','old_zip','부산광역시'), ('50','old_zip','강원도'), ('61','old_zip','NA'), ('04','new_zip','서울특별시'),
          ('11','new_zip','경기도'), ('22','new_zip','인천광역시'), ('31','new_zip','세종특별자치시'), ('42','new_zip','대구광역시'),
          ('61','new_zip','광주광역시'), ('35','new_zip','제주특별자치도')) AS t(zip_code, gb, region)""",
    "income": """
        SELECT donor_no, CAST(tran_amount AS VARCHAR(20)) AS donation_spend, campaign_id AS channel_raw, payment_type AS donor_type
        FROM transactions WHERE gift_date >= DATE '1998-01-01' AND gift_date < DATE '1999-01-01'""",
    "bank_ledger": """
        SELECT CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '취소' ELSE '입금' END AS gb,
          CASE WHEN event_id % 29 = 0 THEN value ELSE 0 END AS spend_out,
          CASE CAST(event_id % 23 AS INT) WHEN 0 THEN '네이버페이01' WHEN 1 THEN 'KT02X' WHEN 2 THEN '하나91Z' WHEN 3 THEN 'X/UK'
            WHEN 4 THEN '지로입금' WHEN 5 THEN NULL WHEN 6 THEN '이자세금' WHEN 7 THEN 'OWN ORGANISATION' WHEN 8 THEN '나이스정보통신'
            WHEN 9 THEN '해피빈재단' WHEN 10 THEN '카카오' WHEN 11 THEN '카카오페이9' WHEN 12 THEN '신한81' WHEN 13 THEN '신한카드자금'
            WHEN 14 THEN 'A KB포' WHEN 15 THEN 'A 국민카드' WHEN 16 THEN '공인인증서발급수수료1' ELSE 'donor' END AS name,
          CASE WHEN event_type = 'click' THEN 'CMS 공동' ELSE '이체' END AS tran_method,
          CASE WHEN event_type = 'view' THEN '국민은행' WHEN event_type = 'signup' THEN NULL ELSE '하나은행' END AS bank,
          SUBSTRING(REPLACE(CAST(ts AS VARCHAR(30)), '-', ''), 3, 4) AS report_ym
        FROM {events}""",
    "change_history": """
        SELECT user_id AS member_no, CASE WHEN event_type IN ('error', 'view') THEN '납부여부' ELSE '주소' END AS field,
          CASE WHEN event_id % 2 = 0 THEN 'Y' ELSE 'N' END AS before_value,
          CASE WHEN event_id % 3 = 0 THEN 'SCMS' ELSE 'desk' END AS changed_by, CAST(ts AS TIMESTAMP) AS changed_at
        FROM {events}""",
    "cms_results": """
        SELECT user_id AS member_no, CAST(ts AS DATE) AS applied_on, CASE WHEN event_id % 5 <> 0 THEN 'Y' ELSE 'N' END AS external_approval,
          CASE WHEN event_type = 'purchase' THEN '해지' ELSE '신규' END AS apply_kind,
          CASE CAST(event_id % 7 AS INT) WHEN 0 THEN '고객해지(PayInfo-고객)' WHEN 1 THEN '고객해지(PayInfo-금융기관)'
            WHEN 2 THEN '고객해지(금융기관)' WHEN 3 THEN NULL ELSE '기타' END AS result_kind,
          CAST(value AS DECIMAL(18,2)) AS amount, 'ok' AS result, CAST(NULL AS VARCHAR(1)) AS message
        FROM {events}""",
    "crm_contacts": """
        SELECT c_custkey AS member_uid, c_custkey AS member_no, DATE '1996-01-01' + CAST(c_custkey % 1400 AS INT) AS joined_on,
          CASE WHEN c_custkey % 4 = 0 THEN 'web' ELSE 'street' END AS join_route, CAST(c_acctbal AS DECIMAL(18,2)) AS total_amount,
          CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS pay_active,
          CASE WHEN c_custkey % 5 <> 0 THEN DATE '2023-10-01' + CAST(c_custkey % 120 AS INT) END AS pay_end_date
        FROM {customer}""",
    "case_log": """
        SELECT doc_id AS case_id, doc_id AS member_uid,
          CASE WHEN doc_id % 3 = 0 THEN CAST(DATE '1998-05-20' + CAST(doc_id % 50 AS INT) AS TIMESTAMP) + INTERVAL '9' HOUR
            ELSE CAST(DATE '1998-05-20' + CAST(doc_id % 50 AS INT) AS TIMESTAMP) END AS recorded_at,
          CASE WHEN lang = 'en' THEN '환불' ELSE '문의' END AS category,
          CASE WHEN doc_id % 5 < 3 THEN '환불완료' ELSE '접수' END AS subcategory,
          CASE WHEN doc_id % 10 = 4 THEN 'notitle' WHEN doc_id % 10 = 6 THEN 'a_b_c_d_e' WHEN doc_id % 10 = 7 THEN 'card__dup'
            WHEN doc_id % 10 = 8 THEN 'CMS_1.5' WHEN doc_id % 10 = 9 THEN NULL
            ELSE 'CMS_' || CAST(n_chars AS VARCHAR(12)) || '_dup' END AS title,
          text AS body
        FROM {documents}""",
    "merge_history": """
        SELECT c_custkey AS merge_id, c_custkey AS surviving_member_no FROM {customer} WHERE c_custkey % 4 = 0""",
    "merge_history_detail": """
        SELECT c_custkey AS merge_id, c_custkey + 1 AS merged_member_no FROM {customer} WHERE c_custkey % 4 = 0
        UNION ALL
        SELECT c_custkey AS merge_id, c_custkey + 4 AS merged_member_no FROM {customer} WHERE c_custkey % 8 = 0
        UNION ALL
        SELECT c_custkey AS merge_id, c_custkey + 8 AS merged_member_no FROM {customer} WHERE c_custkey % 16 = 0""",
}


def _needed(names: tuple[str, ...] | list[str]) -> list[str]:
    """The stand-ins a query needs, each after those it reads."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in STANDIN:
            if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", STANDIN[name]):
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_clause(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named stand-ins and what they read."""
    return "WITH " + ",\n".join(f"{n} AS ({STANDIN[n]})" for n in _needed(names))


def duckdb_clause(*names: str) -> str:
    return with_clause(*names).format(**{t: t for t in BASE_TABLES})


class StandIns:
    """The stand-in source tables of one test directory as DataFrames in the declared schemas."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir
        self._base: dict[str, DataFrame] = {}
        self._frames: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._base[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            text = f"{with_clause(name)}\nSELECT * FROM {name}"
            used = {t: self._table(t) for t in BASE_TABLES if "{" + t + "}" in text}
            self._frames[name] = conform(self._spark.sql(text, **used), TABLES[name], name)
        return self._frames[name]
