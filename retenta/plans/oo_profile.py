"""Yearly profile of one-off givers, from the life-time gift table.

What the report needs of a supporter's history is folded into one aggregate over one scan
(``supporter_facts``). Its columns are numbers and counts, which Spark keeps in a hash map and adds up
before the shuffle, so a supporter or source with much of the table does not land in one task. Jobs that
show a few of those columns select them; Spark drops the others from the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import band, channel_key, classify, rank_map, zip_class
from ..operators import first_per_key, with_lookup
from ..period import Period
from ..vocab import (
    AGE_ORDER, DEFAULT_VOCABULARY, GIFT_GAP_DEFAULT, LIFE_YEAR_LABELS, LIFE_YEAR_ORDER, NO_DATA, OO_VALUE_ORDER,
    REGION_ORDER, Vocabulary,
)
from .profiles import region_columns, with_region

# Gifts carry no id, so ties end on what else tells two gifts apart; beyond that they are equal.
FIRST_GIFT_ORDER = ("transaction_date", "transaction_amount", "source_id", "payment_method", "donation_section")


def _cash_place(source: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Place of the appeal type in the type table, from 0; one past the end for other appeals."""
    labels = [rule.label for rule in vocab.cash_type]
    return rank_map(classify(vocab.cash_type, {"campaign": source}), labels, default=len(labels) + 1) - 1


def _one_off(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    method = F.col("payment_method")
    return (F.col("payment_type") == "1") & method.isNotNull() & ~method.isin(*vocab.oo_excluded_methods)


def one_off_gifts(gifts: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """The year's one-off gifts."""
    return gifts.filter(year.holds_text(F.col("transaction_date")) & _one_off(vocab=vocab))


def _day_text(number: Column) -> Column:
    return number.cast("string")


def supporter_facts(gifts: DataFrame, year: Period, year_only: bool = False, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per supporter with a one-off gift in the year.

    Dates are ``yyyyMMdd`` numbers here. ``year_only`` reads just the year, for jobs that need no history.
    """
    text = F.col("transaction_date")
    until = text < year.end_exclusive.strftime("%Y%m%d")
    in_year = year.holds_text(text)
    scope = gifts.filter(in_year if year_only else until).filter(
        _one_off(vocab=vocab) | ((F.col("payment_type") == "2") & in_year)
    )
    one_off, regular, source = F.col("payment_type") == "1", F.col("payment_type") == "2", F.col("source_id")
    amount = F.col("transaction_amount")
    rows = scope.select(
        "supporter_id",
        text.cast("int").alias("_day"),
        F.when(one_off, amount).alias("_oo_amount"),
        F.when(regular, amount).alias("_rg_amount"),
        one_off.alias("_oo"),
        (one_off & in_year).alias("_oo_year"),
        F.when(one_off & in_year & source.like("%Cash%"), _cash_place(source, vocab=vocab)).alias("_cash"),
        source.like("Cash%").alias("_plain_cash"),
    )
    day, cash = F.col("_day"), F.col("_cash")
    return (
        rows.groupBy("supporter_id")
        .agg(
            F.min(F.when(F.col("_oo_year"), day)).alias("min_oo_day"),
            F.max(F.when(F.col("_oo") & ~F.col("_oo_year"), day)).alias("prior_oo_day"),
            F.min(F.when(F.col("_oo"), day)).alias("first_oo_day"),
            F.min(F.when(~F.col("_oo"), day)).alias("min_rg_day"),
            F.sum("_oo_amount").alias("oo_total"),
            F.count(F.when(F.col("_oo"), F.lit(1))).alias("oo_count"),
            F.count("_oo_amount").alias("oo_amounts"),
            F.sum("_rg_amount").alias("rg_total"),
            F.count(F.when(~F.col("_oo"), F.lit(1))).alias("rg_count"),
            # One bit per appeal type given to.
            F.bit_or(F.when(F.col("_plain_cash"), F.expr("shiftleft(1L, _cash)"))).alias("cash_bits"),
            # Date and type in one number, so that the first type needs no ranking: yyyyMMdd, then the place.
            F.min(day.cast("bigint") * (len(vocab.cash_type) + 1) + cash).alias("first_cash"),
        )
        .filter(F.col("min_oo_day").isNotNull())
    )


def with_oo_channel(first: DataFrame, channels: DataFrame) -> DataFrame:
    """Add the acquisition channel of ``source_id``.

    A source known only for existing donors drops the supporter; an unknown source keeps it with no channel.
    """
    lookup = channels.select("channel_t", "channel_f", "acq_gb")
    return (
        first.withColumn("_key", channel_key(F.col("source_id")))
        .join(lookup, F.col("_key") == F.col("channel_t"), "left")
        .filter((F.col("acq_gb") == "Acquisition") | F.col("channel_t").isNull())
        .drop("_key", "acq_gb")
    )


def _facts_named(facts: DataFrame, **columns: Column) -> DataFrame:
    return facts.select(F.col("supporter_id").alias("_supporter"), *[c.alias(n) for n, c in columns.items()])


def _join_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    return df.join(facts, F.col("supporter_id") == F.col("_supporter"), "left").drop("_supporter")


def _life_time_columns() -> dict[str, Column]:
    return {
        "ty_avg_trans_amt": (F.col("oo_total") / F.nullif(F.col("oo_amounts"), F.lit(0))).cast("decimal(38,6)"),
        "ty_tot_trans_amt": F.col("oo_total").cast("decimal(38,2)"),
        "ty_oo_count": F.col("oo_count"),
    }


def _first_gift(gifts: DataFrame, facts: DataFrame, channels: DataFrame, sections: DataFrame) -> DataFrame:
    """First one-off gift of the year per supporter, beside all their facts, channel and section."""
    first = first_per_key(gifts, ["supporter_id"], FIRST_GIFT_ORDER)
    known = with_oo_channel(_join_facts(first, facts), channels)
    return with_lookup(known, sections, "donation_section", "d_sec_raw", ["d_sec_kor", "d_sec_eng"])


def oo_first_gift(gifts: DataFrame, channels: DataFrame, sections: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """First one-off gift of the year with life-time one-off mean, sum and count, channel and section."""
    facts = _facts_named(supporter_facts(gifts, year, vocab=vocab), **_life_time_columns())
    return _first_gift(one_off_gifts(gifts, year, vocab=vocab), facts, channels, sections)


def _contact_columns(contacts: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    home, office = F.col("home_zip"), F.col("office_zip")
    return contacts.select(
        F.col("donor_no").alias("_donor"),
        F.col("contact_date").alias("contact"),
        F.col("initial_enroll").alias("first_gb"),
        classify(vocab.enrol_type).alias("indi_corp"),
        "gender", "age",
        F.col("birth_date").alias("birth"),
        F.when(F.col("email_opt") == "N", "N").otherwise("Y").alias("email_opt"),
        F.when(F.col("mail_opt") == "수신안함", "N").otherwise("Y").alias("mail_opt"),
        F.coalesce(home, office).alias("all_zip"),
        zip_class(home, office).alias("zip_gb"),
    )


def _donor_info(first: DataFrame, contacts: DataFrame, zip_regions: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    joined = first.join(_contact_columns(contacts, vocab=vocab), F.col("supporter_id") == F.col("_donor"), "left").drop("_donor")
    # A supporter without a contact has no zip class: no class at all, not '', in an outer join.
    classed = joined.withColumn("zip_gb", F.coalesce("zip_gb", F.lit("")))
    opted = classed.withColumns({c: F.coalesce(c, F.lit("Y")) for c in ("email_opt", "mail_opt")})
    return with_region(opted, zip_regions).withColumn(
        "region", F.when(F.col("zip_gb") == "", "").otherwise(F.col("region"))
    )


def _rg_value() -> Column:
    return F.round(F.col("rg_total") / F.nullif(F.col("rg_count"), F.lit(0))).cast("decimal(38,0)")


def oo_donor_info(
    gifts: DataFrame, contacts: DataFrame, channels: DataFrame, sections: DataFrame, zip_regions: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """First gifts with the supporter's attributes, regular gift value of the year and region."""
    facts = _facts_named(supporter_facts(gifts, year, vocab=vocab), **_life_time_columns(), rg_gift_tyvalue=_rg_value())
    return _donor_info(_first_gift(one_off_gifts(gifts, year, vocab=vocab), facts, channels, sections), contacts, zip_regions, vocab=vocab)


def _order_type() -> Column:
    return (
        F.when(F.col("min_rg_day").isNull(), "only_oo_donor")
        .when(F.col("min_oo_day") < F.col("min_rg_day"), "oo_to_rg_donor")
        .otherwise("rg_to_oo_donor")
    )


def gift_order_type(gifts: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Only one-off, one-off before regular, or regular first (the same day counts as regular first)."""
    return supporter_facts(gifts, year, year_only=True, vocab=vocab).select("supporter_id", _order_type().alias("donor_type"))


def _gap_days() -> Column:
    def day(number: str) -> Column:
        return F.to_date(_day_text(F.col(number)), "yyyyMMdd")

    return F.coalesce(F.datediff(day("min_oo_day"), day("prior_oo_day")), F.lit(0))


def prior_gift_gap(gifts: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Days from the last one-off gift before the year to the first in it; 0 if there was none before.

    Every one-off gift of the year is on or after the first, so the latest gift before that first gift is
    the latest before the year: no self-join is needed.
    """
    return supporter_facts(gifts, year, vocab=vocab).select(
        "supporter_id",
        _day_text(F.col("prior_oo_day")).alias("max_tran"),
        _day_text(F.col("min_oo_day")).alias("min_oo_cy_date"),
        _gap_days().alias("duration_before_er"),
    )


def cross_sell(gifts: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One-off supporters of the year, marked if they also gave regularly in it."""
    return supporter_facts(gifts, year, year_only=True, vocab=vocab).select(
        F.col("supporter_id").alias("donor_no"),
        F.when(F.col("rg_count") > 0, "Cross-sell donor").alias("donor_type_ty"),
    )


def _first_cash_type(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    place = F.col("first_cash") % (len(vocab.cash_type) + 1)
    ladder = F
    for number, rule in enumerate(vocab.cash_type):
        ladder = ladder.when(place == number, rule.label)
    return ladder.otherwise(F.lit(None))


def cash_type_first(gifts: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Appeal type of each supporter's first cash gift of the year; on one day, the first in the type table."""
    facts = supporter_facts(gifts, year, year_only=True, vocab=vocab)
    return facts.filter(F.col("first_cash").isNotNull()).select("supporter_id", _first_cash_type(vocab=vocab).alias("cash_type"))


def _many_cash_types(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """More than one of the named appeal types; other appeals do not count."""
    return F.bit_count(F.col("cash_bits").bitwiseAND(F.lit(2 ** len(vocab.cash_type) - 1))) > 1


def cash_type_pivot(gifts: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """A flag per appeal type, and one for more than one type."""
    flags = []
    for place, rule in enumerate(vocab.cash_type):
        given = F.col("cash_bits").bitwiseAND(F.lit(2**place)) > 0
        flags.append(F.when(given, rule.label.lower()).otherwise("").alias(f"ty_{rule.label.lower()}"))
    more = F.when(_many_cash_types(vocab=vocab), "cash_more").otherwise("").alias("cash_more")
    facts = supporter_facts(gifts, year, year_only=True, vocab=vocab)
    return facts.filter(F.col("cash_bits").isNotNull()).select("supporter_id", *flags, more)


def oo_channel_groups(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Three groupings of the acquisition channel; the third reads both channel codes."""
    channel = F.col("channel_f")
    return df.withColumns({
        "channel_gb1": classify(vocab.oo_channel_gb1, otherwise=channel),
        "channel_gb2": classify(vocab.oo_channel_gb2, otherwise=channel),
        "channel_gb3": classify(vocab.oo_channel_gb3, otherwise=channel),
    })


def _life_year(year: Period) -> Column:
    """Years since the first month, clamped to 0..4; no first month counts as 0."""
    first = F.col("first_month")
    begun, month = F.substring(first, 1, 4).cast("int"), F.substring(first, 6, 2).cast("int")
    years = F.floor(((year.year_number - begun) * 12 + (12 - month)) / F.lit(12))
    return F.least(F.greatest(F.coalesce(years, F.lit(0)), F.lit(0)), F.lit(4)).cast("int")


def oo_supporters(
    gifts: DataFrame, contacts: DataFrame, channels: DataFrame, sections: DataFrame, zip_regions: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """One row per one-off supporter of the year with everything the profile groups and adds."""
    facts = _facts_named(
        supporter_facts(gifts, year, vocab=vocab),
        **_life_time_columns(),
        rg_gift_tyvalue=_rg_value(),
        first_oo_date=_day_text(F.col("first_oo_day")),
        donor_type_origin=_order_type(),
        donor_type_ty=F.when(F.col("rg_count") > 0, "Cross-sell donor").otherwise("OO only donor"),
        duration_days=_gap_days(),
        cash_type=_first_cash_type(vocab=vocab),
        many_cash=_many_cash_types(vocab=vocab),
    )
    info = _donor_info(_first_gift(one_off_gifts(gifts, year, vocab=vocab), facts, channels, sections), contacts, zip_regions, vocab=vocab)
    value = F.round(F.col("ty_tot_trans_amt") / F.nullif(F.col("ty_oo_count"), F.lit(0)))
    method = F.col("payment_method")
    return region_columns(oo_channel_groups(info, vocab=vocab), vocab=vocab).withColumns({
        "age_band": band(F.col("age"), vocab.oo_age_bands, NO_DATA),
        "oo_gift_tyvalue": value.cast("decimal(38,0)"),
        "oo_tygift_band": band(value, vocab.oo_value_bands, NO_DATA),
        "rg_tygift_band": band(F.col("rg_gift_tyvalue"), vocab.oo_value_bands, NO_DATA),
        "cash_type_2": F.when(F.col("many_cash"), "Cash_MORE").otherwise(F.col("cash_type")),
        "donor_gb": F.when(F.substring("first_month", 1, 4) == year.label, "New").otherwise("Existing"),
        "life_year": F.get(F.array(*[F.lit(x) for x in LIFE_YEAR_LABELS]), _life_year(year)),
        "earmarking_eng": F.col("d_sec_eng"),
        "first_earmarking_before": classify(vocab.earmark, otherwise=vocab.earmark_default),
        "duration_before_er": F.coalesce(band(F.col("duration_days"), vocab.gift_gap_bands), F.lit(GIFT_GAP_DEFAULT)),
        "oo_cy_pay_method_gb": F.when(~method.isin(*vocab.oo_shown_methods), "Others").otherwise(method),
    })


def oo_profile(
    gifts: DataFrame, contacts: DataFrame, channels: DataFrame, sections: DataFrame, zip_regions: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    """The profile by eighteen raw keys; labels are put on after grouping, so equal labels may repeat."""
    keys = [
        "channel_gb2", "channel_f", "cash_type_2", "donor_type_ty", "donor_type_origin", "donor_gb", "oo_tygift_band",
        "rg_tygift_band", "age_band", "gender", "region_3", "email_opt", "mail_opt", "life_year", "earmarking_eng",
        "oo_cy_pay_method_gb", "first_earmarking_before", "duration_before_er",
    ]
    grouped = (
        oo_supporters(gifts, contacts, channels, sections, zip_regions, year, vocab=vocab)
        .groupBy(*keys)
        .agg(
            F.count("supporter_id").alias("count"),
            F.sum("ty_tot_trans_amt").cast("decimal(38,2)").alias("tot_oo_tygift"),
            F.sum("ty_oo_count").alias("tot_oo_gift_tyfreq"),
            F.sum("age").alias("tot_avg_age"),
        )
    )
    return grouped.select(
        classify(vocab.oo_channel_short, otherwise=F.col("channel_gb2")).alias("channel_s"),
        F.col("channel_f").alias("channel_f_wncash"),
        F.coalesce("cash_type_2", F.lit("No Cash donor")).alias("cash_type_2"),
        "donor_type_ty", "donor_type_origin", "donor_gb", "oo_tygift_band", "rg_tygift_band", "age_band", "gender",
        "region_3", "email_opt", "mail_opt", "life_year", "earmarking_eng", "count", "tot_oo_tygift",
        "tot_oo_gift_tyfreq", "tot_avg_age", "first_earmarking_before",
        F.col("duration_before_er").alias("oo_donation_freq"),
        F.col("oo_cy_pay_method_gb").alias("oo_cy_pay_method"),
    )


def oo_profile_rows(profile: DataFrame, year: Period) -> DataFrame:
    """The profile as stored over the years: year, two labels left out, four sort orders added."""
    return profile.select(
        F.lit(year.label).alias("year"), "channel_s", "channel_f_wncash",
        F.col("cash_type_2").alias("cash_donor_type_ty"),
        "donor_type_ty", "donor_type_origin", "donor_gb", "oo_tygift_band", "rg_tygift_band", "age_band", "gender",
        "region_3", "email_opt", "mail_opt", "life_year", "earmarking_eng",
        F.col("count").cast("decimal(38,0)").alias("count"),
        "tot_oo_tygift",
        F.col("tot_oo_gift_tyfreq").cast("decimal(38,0)").alias("tot_oo_gift_tyfreq"),
        "tot_avg_age", "oo_cy_pay_method",
        F.col("oo_cy_pay_method").alias("oo_cy_pay_method_combined"),
        rank_map(F.col("oo_tygift_band"), OO_VALUE_ORDER).alias("oo_tygift_band_order"),
        rank_map(F.col("age_band"), AGE_ORDER).alias("age_band_order"),
        rank_map(F.col("life_year"), LIFE_YEAR_ORDER).alias("life_year_band_order"),
        rank_map(F.col("region_3"), REGION_ORDER).alias("region_3_order"),
    )
