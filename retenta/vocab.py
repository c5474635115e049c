"""Code lists and rule tables the jobs use.

Everything here is a fixed value: the codes, labels, patterns and band edges that stand in the source
tables or must appear in the reports. Pass a changed copy (``dataclasses.replace``) to a job to report
under other rules. ``own_name`` is the name of the organisation that runs the reports; it is part of a
label, of a name pattern and of the bank-ledger rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from .functions.rules import Band, Rule, above, is_null, isin, like, same, unlike

# --- Fixed values: codes ------------------------------------------------------------------------------

RECURRING_METHODS = ("CMS", "신용카드", "NPay", "KakaoPay")
BANK_TRANSFER = "무통장입금"
ONE_OFF = "수시"
OVERDUE_REASON = "장기미납%"
OFFICE_ROUTE = "후원자관리팀"

COMMITMENT_EXCLUDED_NAMES = (
    "test", "테스트", "비회원", "benevity", "이니스트", "{own}", "kt ars", "해피빈", "카카오펀딩스토리",
    "카카오 같이가치", "비회원 문의", "온라인 무통장입금", "중복후원삭제", "현장취소삭제",
)
CANCELLED_EXCLUDED_NAMES = ("test", "테스트", "삭제")
CHECK_EXCLUDED_NAMES = ("%테스트%", "%test%")

REACTIVATION_SITE = "1.3 Reactivation"
CONVERSION_SITE = "2.6 Conversion"
LAPSED_EXCLUDED_SITES = (
    "1.3 Reactivation", "2.5 Upgrade", "2.6 Conversion", "2.7 MVD", "5.4 HNWIs", "5.1 Corporate",
    "5.3 Foundations",
)
NON_ACQUIRING_CHANNELS = ("UPGRADE", "ONEOFF")
NON_ACQUIRING_CHANNEL_PATTERNS = ("UP_%", "PPH%")
LAPSED_EXCLUDED_CAMPAIGNS = ("PPH%", "UP%", "ONE%", "Reacti%")
RG_EXCLUDED_CAMPAIGNS = ("UPGRADE%", "ONEOFF%", "UP_%", "PPH%")
MONTHLY_LIST_EXCLUDED_CAMPAIGNS = ("UP%", "Reactivation%", "Cash%")
LIST_EXCLUDED_CAMPAIGNS_ANY_CASE = ("pph%",)
REACTIVATION_CAMPAIGNS, CONVERSION_CAMPAIGNS = ("Reactivation%",), ("CONVERSION%",)
SITE_CODE_LITERAL = "2.%"

OO_EXCLUDED_METHODS = ("HappyBean",)
OO_SHOWN_METHODS = ("Credit Card", "Virtual Account", "Wire Transfer", "Real Time Wire Transfer", "CMS")

# --- Fixed values: labels of one code -----------------------------------------------------------------

PLEDGE_STATUS = (
    Rule.of("end", same("pledge_status", "종료")),
    Rule.of("progress", same("pledge_status", "진행")),
    Rule.of("pause", same("pledge_status", "일시중지")),
    Rule.of("?", same("pledge_status", "대기")),
)
ENROL_TYPE = (
    Rule.of("Individual", same("enroll", "개인")),
    Rule.of("Group", same("enroll", "기업/단체")),
    Rule.of("Foreigner", same("enroll", "외국인")),
)
COLLECTOR_ROUTE = (
    Rule.of("PayInfo", isin("result_kind", "고객해지(PayInfo-고객)", "고객해지(PayInfo-금융기관)")),
    Rule.of("Bank", isin("result_kind", "고객해지(금융기관)")),
)
CASH_TYPE = (
    Rule.of("Cash_SMS", like("campaign", "%Cash_SMS%")),
    Rule.of("Cash_DM", like("campaign", "%Cash_DM%")),
    Rule.of("Cash_EMAIL", like("campaign", "%Cash_EMAIL%")),
    Rule.of("Cash_MULTI", like("campaign", "%Cash_MULTI%")),
)
EARMARK = (
    Rule.of("TS ER", same("d_sec_eng", "Earthquakes in Türkiye and Syria")),
    Rule.of("SYR ER", same("d_sec_eng", "Syria Emergency")),
    Rule.of("UKR ER", same("d_sec_eng", "Ukraine Emergency")),
    Rule.of("Unearmarked", same("d_sec_eng", "Unearmarked Donations")),
    Rule.of("Global Shelter", same("d_sec_eng", "Global Shelter Campaign")),
    Rule.of("Other ER", like("d_sec_eng", "%Emergency%")),
)
EARMARK_DEFAULT = "General"

# --- Fixed values: number bands -----------------------------------------------------------------------

TENURE_QUARTER_BANDS = (
    Band("0M~3M", 0, 3), Band("4M~6M", 4, 6), Band("7M~9M", 7, 9), Band("10M~12M", 10, 12),
)
TENURE_YEAR_BANDS = (Band("1YR", 0, 12),)
RG_AGE_BANDS = (
    Band("under 18", 1, 18), Band("19~25", 19, 25), Band("26~30", 26, 30), Band("31~40", 31, 40),
    Band("41~50", 41, 50), Band("51~60", 51, 60), Band("over 61", 61, None),
)
OO_AGE_BANDS = (
    Band("under 18", None, 18), Band("19~25", 19, 25), Band("26~30", 26, 30), Band("31~40", 31, 40),
    Band("41~50", 41, 50), Band("51~60", 51, 60), Band("over 61", 61, None),
)
RG_GIFT_BANDS = (
    Band("under 10,000", None, 10000), Band("10,001~15,000", 10001, 15000), Band("15,001~20,000", 15001, 20000),
    Band("20,001~30,000", 20001, 30000), Band("30,001~50,000", 30001, 50000), Band("over 50,001", 50001, None),
)
# Whole-number edges over an unrounded mean: a mean inside a gap takes the default label.
CROSS_SELL_BANDS = (
    Band("under 10,000", None, 10000), Band("10,001~50,000", 10001, 50000), Band("50,001~100,000", 50001, 100000),
    Band("100,001~500,000", 100001, 500000), Band("500,001~1,000,000", 500001, 1000000),
)
CROSS_SELL_OVER = (1000000, "over 1,000,001")
CROSS_SELL_DEFAULT = "rg_only_donor"
OO_VALUE_BANDS = (
    Band("under 10k", None, 10000), Band("10k~20k", None, 20000), Band("20k~30k", None, 30000),
    Band("30k~50k", None, 50000), Band("50k~100k", None, 100000), Band("100k~1m", None, 1000000),
    Band("over 1m", 1000000, None),
)
LIFE_YEAR_LABELS = ("New Active", "Over 1yr", "Over 2yrs", "Over 3yrs", "Over 4yrs")
GIFT_GAP_BANDS = (
    Band("None", 0, 0), Band("less than 1yr", 1, 364), Band("1yr", 365, 729), Band("2yrs", 730, 1097),
    Band("Over 3yrs", 1098, None),
)
GIFT_GAP_DEFAULT = "No TSER donor"
NO_DATA = "No data"

# --- Fixed values: report orders ----------------------------------------------------------------------

OO_VALUE_ORDER = ("under 10k", "10k~20k", "20k~30k", "30k~50k", "50k~100k", "100k~1m", "over 1m")
AGE_ORDER = ("under 18", "19~25", "26~30", "31~40", "41~50", "51~60", "over 61", "No data")
LIFE_YEAR_ORDER = ("New Active", "Over 1yr", "Over 2yrs", "Over 3yrs", "Over 4yrs")
REGION_ORDER = ("Seoul Metropolitan Area", "Urban Cities", "Other Provinces", "No data")

# --- Fixed values: channel groups ---------------------------------------------------------------------

RECRUIT_CHANNEL = (
    Rule.of("F2F SW", like("channel", "F2F APPCO%", "F2F SW%")),
    Rule.of("F2F DN", like("channel", "F2F DN%")),
    Rule.of("F2F KDA", like("channel", "F2F KDA%")),
    Rule.of("F2F LW", like("channel", "F2F LW%")),
    Rule.of("F2F OM", like("channel", "F2F OM%")),
    Rule.of("F2F PN", like("channel", "F2F PN%")),
    Rule.of("F2F GW", like("channel", "F2F GW%")),
)
F2F_TYPE = (
    Rule.of("B2B", like("channel", "%B2B")),
    Rule.of("Street", like("channel", "F2F%"), unlike("channel", "%B2B")),
)
F2F_DETAIL = (
    Rule.of(
        None,
        like("channel", "F2F APPCO%", "F2F SW%", "F2F DN%", "F2F KDA%", "F2F LW%", "F2F OM%", "F2F PN%", "F2F IH%",
             "F2F GW%"),
        keep="channel",
    ),
)

_MULTI_MEDIA = ("Multi_DRTV", "Multi_MAIL", "DRTV_SMS Lead", "Multi_NEWSPAPER", "Multi_Magazine")
_DRTV_FAMILY = ("Multi_DRTV", "Multi_MAIL", "DRTV_SMS Lead", "DRTV", "DRRD", "DRTVWN", "Multi_NEWSPAPER",
                "Multi_Magazine")
_OO_OTHER = ("HCR_COMP", "MAIL", "OTHER", "MAILWITHU")
_OO_ONLINE = ("Campaign1", "ONLINE", "Multi_Digital Lead", "Multi_SMS")
_PPH = ("PPHCORP", "PPHFOUNDATION", "PPHHNWI")

RG_CHANNEL_G1 = (
    Rule.of("F2F TOTAL", like("channel_t", "F2F%")),
    Rule.of("Online", same("channel_t", "ONLINE")),
    Rule.of("DRTV", same("channel_t", "DRTV")),
    Rule.of("DRTV_SMS/Multi_MAIL/NEWSPAPER/Magazine", isin("channel_t", *_MULTI_MEDIA)),
    Rule.of("Multi_Digital/SMS", isin("channel_t", "Multi_Digital Lead", "Multi_SMS")),
    Rule.of("HCR_COMP/MAIL/OTHER", isin("channel_t", "HCR_COMP", "MAIL", "OTHER")),
)
RG_CHANNEL_G2 = (
    Rule.of("F2F AGENCY", like("channel_t", "F2F SW%", "F2F DN%", "F2F KDA%", "F2F LW%", "F2F OM%", "F2F PN%",
                               "F2F_AGENCY")),
    Rule.of("F2F IH", like("channel_t", "F2F IH%")),
    Rule.of("Others", isin("channel_t", "HCR_COMP", "MAIL", "OTHER")),
    Rule.of("ONLINE", isin("channel_t", "HopeTV", "Multi_Digital Lead", "Multi_SMS")),
    Rule.of("DRTV", isin("channel_t", *_DRTV_FAMILY)),
)
RG_CHANNEL_G3 = (
    Rule.of("F2F SW_Street", like("channel_t", "F2F_SW%"), unlike("channel_t", "%B2B%")),
    Rule.of("F2F SW_B2B", like("channel_t", "F2F_SW%"), like("channel_t", "%B2B%")),
    Rule.of("F2F DN", like("channel_t", "F2F_DN%")),
    Rule.of("F2F PN", like("channel_t", "F2F_PN%")),
    Rule.of("F2F KDA", like("channel_t", "F2F_KDA%")),
    Rule.of("F2F LW", like("channel_t", "F2F_LW%")),
    Rule.of("F2F OM", like("channel_t", "F2F_OM%")),
    Rule.of("F2F IH", like("channel_t", "F2F_IH%")),
    Rule.of("F2F AGENCY", like("channel_t", "F2F_AGENCY")),
)
RG_CHANNEL_G3_DEFAULT = "Not F2F Agency"
RG_CHANNEL_G4 = (
    Rule.of("F2F SW", like("channel_t", "F2F_SW%")),
    Rule.of("F2F DN", like("channel_t", "F2F_DN%")),
    Rule.of("F2F PN", like("channel_t", "F2F_PN%")),
    Rule.of("F2F KDA", like("channel_t", "F2F_KDA%")),
    Rule.of("F2F LW", like("channel_t", "F2F_LW%")),
    Rule.of("F2F OM", like("channel_t", "F2F_OM%")),
    Rule.of("F2F IH", like("channel_t", "F2F_IH%")),
)

OO_CHANNEL_GB1 = (
    Rule.of("F2F TOTAL", like("channel_f", "F2F%")),
    Rule.of("ONLINE", isin("channel_f", "Campaign1", "ONLINE")),
    Rule.of("DRTV", same("channel_f", "DRTV")),
    Rule.of("DRTV_SMS/Multi_MAIL/NEWSPAPER/Magazine", isin("channel_f", *_MULTI_MEDIA)),
    Rule.of("Multi_Digital/SMS", isin("channel_f", "Multi_Digital Lead", "Multi_SMS")),
    Rule.of("HCR_COMP/MAIL/OTHER", isin("channel_f", *_OO_OTHER)),
    Rule.of("PPH", isin("channel_f", *_PPH)),
)
OO_CHANNEL_GB2 = (
    Rule.of("F2F AGENCY", like("channel_f", "F2FSW%", "F2FDN%", "F2FKDA%", "F2FLW%", "F2FOM%", "F2FPN%")),
    Rule.of("F2F IH", like("channel_f", "F2FIH%")),
    Rule.of("HCR_COMP/MAIL/OTHER", isin("channel_f", *_OO_OTHER)),
    Rule.of("DRTV_T", isin("channel_f", *_DRTV_FAMILY)),
    Rule.of("ONLINE_T", isin("channel_f", *_OO_ONLINE)),
    Rule.of("PPH_T", isin("channel_f", *_PPH)),
)
OO_CHANNEL_GB3 = (
    Rule.of("F2F SW_T", like("channel_t", "F2FSW%"), unlike("channel_t", "%B2B%")),
    Rule.of("F2F SW_B2B_T", like("channel_t", "F2FSW%"), like("channel_f", "%B2B%")),
    Rule.of("F2F DN_T", like("channel_t", "F2FDN%")),
    Rule.of("F2F PN_T", like("channel_t", "F2FPN%")),
    Rule.of("F2F KDA_T", like("channel_t", "F2FKDA%")),
    Rule.of("F2F LW_T", like("channel_t", "F2FLW%")),
    Rule.of("F2F OM_T", like("channel_t", "F2FOM%")),
    Rule.of("F2F IH_T", like("channel_t", "F2FIH%")),
    Rule.of("PPH_T", isin("channel_f", *_PPH)),
    Rule.of("DRTV_T", isin("channel_f", *_DRTV_FAMILY)),
    Rule.of("HCR_COMP/MAIL/OTHER", isin("channel_f", *_OO_OTHER)),
    Rule.of("ONLINE_T", isin("channel_f", *_OO_ONLINE)),
)
OO_CHANNEL_SHORT = (
    Rule.of("DRTV", same("channel_gb2", "DRTV_T")),
    Rule.of("Multi_Channel", same("channel_gb2", "Multi_Channel_T")),
    Rule.of("Others", isin("channel_gb2", "HCR_COMP/MAIL/OTHER", "HOPETV")),
    Rule.of("ONLINE", same("channel_gb2", "ONLINE_T")),
    Rule.of("PPH", same("channel_gb2", "PPH_T")),
    Rule.of("F2F AGENCY", isin("channel_gb2", "F2F AGENCY", "F2F_AGENCY")),
)

# --- Fixed values: regions ----------------------------------------------------------------------------

REGION_NO_DATA = ("", "NA")
REGION_GROUPS = (
    Rule.of("서울,경기,인천", isin("region", "서울특별시", "경기도", "인천광역시")),
    Rule.of("대구,경북", isin("region", "대구광역시", "경상북도")),
    Rule.of("부산,울산,경남", isin("region", "울산광역시", "부산광역시", "경상남도")),
    Rule.of("광주,전라", isin("region", "광주광역시", "전라남도", "전라북도")),
    Rule.of("대전,충청,세종", isin("region", "대전광역시", "충청남도", "충청북도", "세종특별자치시")),
    Rule.of("강원", isin("region", "강원도")),
    Rule.of("제주", isin("region", "제주특별자치도")),
)
REGION_CLASSES = (
    Rule.of("Seoul Metropolitan Area", isin("region", "서울특별시", "경기도", "인천광역시")),
    Rule.of("Urban Cities", isin("region", "대구광역시", "울산광역시", "부산광역시", "광주광역시", "대전광역시")),
    Rule.of("Other Provinces", isin("region", "경상북도", "경상남도", "전라남도", "전라북도", "충청남도", "충청북도",
                                    "세종특별자치시", "강원도", "제주특별자치도")),
)


def _cancel_route(own_name: str) -> tuple[Rule, ...]:
    # Cancellation routes and their report labels.
    return (
        Rule.of(f"{own_name} Website", same("cancel_route", "홈페이지")),
        Rule.of("Donorcare line", isin("cancel_route", "전화", "콜센터 IN", "콜센터 OUT")),
        Rule.of("Email/Mail", isin("cancel_route", "이메일", "우편")),
        Rule.of("No data", same("cancel_route", OFFICE_ROUTE), unlike("cancel_reason", OVERDUE_REASON)),
        Rule.of("Donorcare line", is_null("cancel_route")),
    )


def _bank_ledger(own_name: str) -> tuple[Rule, ...]:
    # Bank-ledger patterns and income classes, in order of precedence.
    return (
        Rule.of("제외", like("gb", "취소%")),
        Rule.of("제외", above("spend_out", 0)),
        Rule.of("제외", like("name", "이자세금%")),
        Rule.of("제외", same("name", own_name)),
        Rule.of("제외", like("name", "공인인증서발급수수료%")),
        Rule.of("CMS", same("tran_method", "CMS 공동")),
        Rule.of("PG", isin("name", "나이스페이먼츠", "NICE페이먼츠(", "NICE페이먼츠", "나이스정보통신")),
        Rule.of("지로", isin("name", "지로입금")),
        Rule.of("해피빈", like("name", "해피빈%")),
        Rule.of("카카오스토리펀딩", isin("name", "카카오")),
        Rule.of("네이버페이", like("name", "네이버페이%")),
        Rule.of("카카오페이", like("name", "카카오페이%")),
        Rule.of("KT", like("name", "KT02%")),
        Rule.of("신한카드 포인트", like("name", "신한8%", "신한법인%")),
        Rule.of("신한카드 포인트", same("name", "신한카드자금")),
        Rule.of("하나카드 포인트", same("bank", "하나은행"), like("name", "하나91%")),
        Rule.of("KB카드 포인트", like("name", "%KB국민%", "%KB포%", "%국민카드%", "%KB 포%")),
        Rule.of("베네비티", like("name", "%/UK%")),
    )


@dataclass(frozen=True)
class Vocabulary:
    """The values and rules a run reports under. ``rule_tables`` reads and writes the rules and bands among them as rows."""

    own_name: str = "OWN ORGANISATION"
    recurring_methods: tuple[str, ...] = RECURRING_METHODS
    commitment_excluded_names: tuple[str, ...] = COMMITMENT_EXCLUDED_NAMES
    cancelled_excluded_names: tuple[str, ...] = CANCELLED_EXCLUDED_NAMES
    check_excluded_names: tuple[str, ...] = CHECK_EXCLUDED_NAMES
    lapsed_excluded_sites: tuple[str, ...] = LAPSED_EXCLUDED_SITES
    lapsed_excluded_campaigns: tuple[str, ...] = LAPSED_EXCLUDED_CAMPAIGNS
    monthly_list_excluded_campaigns: tuple[str, ...] = MONTHLY_LIST_EXCLUDED_CAMPAIGNS
    list_excluded_campaigns_any_case: tuple[str, ...] = LIST_EXCLUDED_CAMPAIGNS_ANY_CASE
    rg_excluded_campaigns: tuple[str, ...] = RG_EXCLUDED_CAMPAIGNS
    non_acquiring_channels: tuple[str, ...] = NON_ACQUIRING_CHANNELS
    non_acquiring_channel_patterns: tuple[str, ...] = NON_ACQUIRING_CHANNEL_PATTERNS
    reactivation_campaigns: tuple[str, ...] = REACTIVATION_CAMPAIGNS
    conversion_campaigns: tuple[str, ...] = CONVERSION_CAMPAIGNS
    oo_excluded_methods: tuple[str, ...] = OO_EXCLUDED_METHODS
    oo_shown_methods: tuple[str, ...] = OO_SHOWN_METHODS
    region_no_data: tuple[str, ...] = REGION_NO_DATA
    earmark_default: str = EARMARK_DEFAULT
    rg_channel_g3_default: str = RG_CHANNEL_G3_DEFAULT
    cross_sell_over: tuple[int, str] = CROSS_SELL_OVER
    pledge_status: tuple[Rule, ...] = PLEDGE_STATUS
    enrol_type: tuple[Rule, ...] = ENROL_TYPE
    collector_route: tuple[Rule, ...] = COLLECTOR_ROUTE
    cash_type: tuple[Rule, ...] = CASH_TYPE
    earmark: tuple[Rule, ...] = EARMARK
    recruit_channel: tuple[Rule, ...] = RECRUIT_CHANNEL
    f2f_type: tuple[Rule, ...] = F2F_TYPE
    f2f_detail: tuple[Rule, ...] = F2F_DETAIL
    rg_channel_g1: tuple[Rule, ...] = RG_CHANNEL_G1
    rg_channel_g2: tuple[Rule, ...] = RG_CHANNEL_G2
    rg_channel_g3: tuple[Rule, ...] = RG_CHANNEL_G3
    rg_channel_g4: tuple[Rule, ...] = RG_CHANNEL_G4
    oo_channel_gb1: tuple[Rule, ...] = OO_CHANNEL_GB1
    oo_channel_gb2: tuple[Rule, ...] = OO_CHANNEL_GB2
    oo_channel_gb3: tuple[Rule, ...] = OO_CHANNEL_GB3
    oo_channel_short: tuple[Rule, ...] = OO_CHANNEL_SHORT
    region_groups: tuple[Rule, ...] = REGION_GROUPS
    region_classes: tuple[Rule, ...] = REGION_CLASSES
    tenure_quarter_bands: tuple[Band, ...] = TENURE_QUARTER_BANDS
    tenure_year_bands: tuple[Band, ...] = TENURE_YEAR_BANDS
    rg_age_bands: tuple[Band, ...] = RG_AGE_BANDS
    oo_age_bands: tuple[Band, ...] = OO_AGE_BANDS
    rg_gift_bands: tuple[Band, ...] = RG_GIFT_BANDS
    cross_sell_bands: tuple[Band, ...] = CROSS_SELL_BANDS
    oo_value_bands: tuple[Band, ...] = OO_VALUE_BANDS
    gift_gap_bands: tuple[Band, ...] = GIFT_GAP_BANDS
    #: Without rules of their own these two ladders are made for ``own_name``.
    cancel_route_rules: tuple[Rule, ...] | None = None
    bank_ledger_rules: tuple[Rule, ...] | None = None

    def __post_init__(self) -> None:
        if len(self.cash_type) > 62:  # the bits of a long hold the types given to
            raise ValueError("at most 62 appeal types")

    @property
    def commitment_name_words(self) -> tuple[str, ...]:
        return tuple(w.format(own=self.own_name.lower()) for w in self.commitment_excluded_names)

    @property
    def cancel_route(self) -> tuple[Rule, ...]:
        return _cancel_route(self.own_name) if self.cancel_route_rules is None else self.cancel_route_rules

    @property
    def bank_ledger(self) -> tuple[Rule, ...]:
        return _bank_ledger(self.own_name) if self.bank_ledger_rules is None else self.bank_ledger_rules


DEFAULT_VOCABULARY = Vocabulary()
