"""Yearly profile of regular givers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    band, channel_key, classify, first_of_month_text, one_of_like, whole_number, whole_years_between, zip_class,
)
from ..operators import split_outliers, with_lookup
from ..period import Period
from ..vocab import CROSS_SELL_DEFAULT, DEFAULT_VOCABULARY, LIFE_YEAR_LABELS, NO_DATA, ONE_OFF, Vocabulary
from .commitments import existing_channels
from .profiles import region_columns, with_region


def rg_active_base(pledges: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Donors with a regular pledge active at year end: latest pledge's name and channel, and pledge count.

    One aggregate per donor instead of two windows, so a donor with very many pledges is added up before
    the shuffle. Latest is by date, then by pledge id; no date counts as earliest.
    """
    end = F.lit(year.end_exclusive)
    campaign = F.col("campaign_raw")
    active = pledges.filter(
        (F.col("submit_date").isNull() | (F.col("submit_date") < end))
        & (F.col("all_end_date").isNull() | (F.col("all_end_date") >= end))
        & campaign.isNotNull()
        & F.col("payment_method").isin(*vocab.recurring_methods)
        & F.col("start_month").isNotNull()
        & (F.col("end_month").isNull() | (F.col("end_month") > year.last_day.strftime("%Y-%m")))
        & F.col("user_type2").isNull()
        & ~one_of_like(campaign, vocab.rg_excluded_campaigns)
    )
    latest = F.max_by(
        F.struct("name", channel_key(campaign).alias("channel_pre")), F.struct("submit_date", "pledge_uid")
    )
    return (
        active.groupBy("donor_no")
        .agg(latest.alias("_latest"), F.count(F.lit(1)).alias("pledge_count"))
        .select("donor_no", "_latest.name", "_latest.channel_pre", "pledge_count")
    )


def _padded_zip() -> Column:
    code = F.coalesce("home_zip", "office_zip", F.lit(""))
    return F.when(F.col("zip_gb") == "new_zip", F.lpad(code, 5, "0")).otherwise(code)


def _life_year_label(years: Column) -> Column:
    ladder = F
    for limit, label in enumerate(LIFE_YEAR_LABELS[:-1], start=1):
        ladder = ladder.when(years < limit, label)
    return ladder.otherwise(LIFE_YEAR_LABELS[-1])


def rg_donor_info(base: DataFrame, contacts: DataFrame, channels: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Donor attributes, bands, opt-ins and postal code of the active regular givers."""
    age = F.col("age") - 1  # ages are drawn in the year after the reported one
    donors = contacts.select(
        F.col("donor_no").alias("_donor"),
        F.col("contact_date").alias("sign_up_date"),
        F.col("initial_enroll").alias("first_gb"),
        classify(vocab.enrol_type).alias("indi_corp"),
        F.when(F.col("mvd_type").like("MVD%") & (F.col("mvd_type") != "MVD-PP"), "MVD").alias("mvd_gb"),
        "gender",
        age.alias("age"),
        F.col("birth_date").alias("birth"),
        "payment_method",
        F.col("first_month").alias("first_payment"),
        F.col("start_month").alias("s_month"),
        F.col("rg_amount").alias("gift_amount"),
        F.col("tot_amt").alias("tot_gift_amount"),
        F.col("tot_tran").alias("tot_gift_tran"),
        "campaign_raw", "email_opt", "mail_opt", "home_zip", "office_zip",
    )
    lookup = existing_channels(channels, vocab=vocab).select(F.col("channel_t").alias("_key"), "channel_excl_upgrade")
    years = whole_years_between(F.lit(year.last_day), first_of_month_text(F.col("first_payment")))
    joined = base.join(donors, F.col("donor_no") == F.col("_donor"), "left").drop("_donor")
    return (
        with_lookup(joined, lookup, "channel_pre", "_key", ["channel_excl_upgrade"])
        .withColumnRenamed("channel_excl_upgrade", "channel_t")
        .withColumns({
            "age_band": band(F.col("age"), vocab.rg_age_bands, NO_DATA),
            "gift_band": band(whole_number(F.col("gift_amount")), vocab.rg_gift_bands, NO_DATA),
            "life_year_raw": years,
            "life_year_band": _life_year_label(years),
            "email_opt": F.when(F.col("email_opt") == "N", False).otherwise(True),
            "mail_opt": F.when(F.col("mail_opt") == "수신안함", False).otherwise(True),
            "zip_gb": zip_class(F.col("home_zip"), F.col("office_zip")),
        })
        .withColumn("all_zip", _padded_zip())
        .select(
            "donor_no", "name", "pledge_count", "sign_up_date", "first_gb", "indi_corp", "mvd_gb", "gender", "age",
            "birth", "payment_method", "first_payment", "s_month", "gift_amount", "tot_gift_amount", "tot_gift_tran",
            "channel_t", "campaign_raw", "age_band", "gift_band", "life_year_raw", "life_year_band", "email_opt",
            "mail_opt", "all_zip", "zip_gb",
        )
    )


def _spend() -> Column:
    return F.col("donation_spend").cast("decimal(18,2)")


def _income_sums(income: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Upgrade, one-off and cash sums per donor and appeal type, from one pass over the year's income."""
    upgrade, one_off = F.col("channel_raw").like("%UP%"), F.col("donor_type") == ONE_OFF
    cash = F.col("channel_raw").like("%Cash%")
    kind = F.when(cash, classify(vocab.cash_type, {"campaign": F.col("channel_raw")}, "No_cash_donor"))
    rows = income.filter(upgrade | one_off | cash).select(
        F.col("donor_no").alias("_donor"), kind.alias("cash_type"), _spend().alias("_spend"),
        upgrade.alias("_up"), one_off.alias("_oo"), cash.alias("_cash"),
    )

    def sums(name: str) -> list[Column]:
        flag = F.col(f"_{name}")
        return [F.count(F.when(flag, F.lit(1))).alias(f"{name}_rows"), F.count(F.when(flag, F.col("_spend"))).alias(f"{name}_amounts"),
                F.sum(F.when(flag, F.col("_spend"))).alias(f"{name}_sum")]

    return rows.groupBy("_donor", "cash_type").agg(*sums("up"), *sums("oo"), *sums("cash"))


def _mean(total: Column, count: Column) -> Column:
    return total.cast("decimal(28,2)") / F.nullif(count, F.lit(0))


def with_income(info: DataFrame, income: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Donors beside their upgrade and one-off totals, and a row for each of their cash appeal types."""
    sums = _income_sums(income, vocab=vocab)
    whole = Window.partitionBy("_donor")
    total = {c: F.sum(c).over(whole).alias(f"_{c}") for n in ("up", "oo") for c in (f"{n}_rows", f"{n}_amounts", f"{n}_sum")}
    has_cash = F.max((F.col("cash_rows") > 0).cast("int")).over(whole).alias("_has_cash")
    # One row a donor and type: a donor without cash appeals keeps one, a donor with them those of the types.
    facts = sums.select("_donor", "cash_type", "cash_rows", "cash_amounts", "cash_sum", *total.values(), has_cash)
    facts = facts.filter((F.col("_has_cash") == 0) | (F.col("cash_rows") > 0)).select(
        "_donor", "cash_type",
        F.when(F.col("cash_rows") > 0, F.col("cash_rows")).alias("cash_count"),
        F.round(_mean(F.col("cash_sum"), F.col("cash_amounts"))).cast("decimal(38,0)").alias("avg_cash_amt"),
        F.col("cash_sum").cast("decimal(38,2)").alias("tot_cash_amt"),
        F.col("_up_rows").alias("_up_count"),
        F.round(_mean(F.col("_up_sum"), F.col("_up_amounts"))).cast("decimal(38,0)").alias("avg_up_amt"),
        F.col("_up_sum").cast("decimal(38,2)").alias("tot_up_amt"),
        F.col("_oo_rows").alias("_oo_count"),
        _mean(F.col("_oo_sum"), F.col("_oo_amounts")).alias("_avg_oo_gift"),
    )
    return info.join(facts, F.col("donor_no") == F.col("_donor"), "left")


def rg_addons(info: DataFrame, income: DataFrame, zip_regions: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Donor info with upgrade, cash appeal, region and cross-sell columns.

    Cash types multiply a donor's rows, as the profile counts a donor once per type.
    """
    average = F.col("_avg_oo_gift")
    over, over_label = vocab.cross_sell_over
    extended = (
        region_columns(with_region(with_income(info, income, vocab=vocab), zip_regions).withColumn("region", F.coalesce("region", F.lit(""))), vocab=vocab)
        .withColumns({
            "upgrade": F.when(F.col("_up_count") > 0, "RG_Upgrade").otherwise("No_Upgrade"),
            "up_count": F.nullif(F.col("_up_count"), F.lit(0)),
            "cross_sell": F.when(F.col("_oo_count") > 0, "cross_sell").otherwise(""),
            "avg_oo_gift_band": F.when(average > over, over_label).otherwise(
                band(average, vocab.cross_sell_bands, CROSS_SELL_DEFAULT)
            ),
            "oo_count": F.nullif(F.col("_oo_count"), F.lit(0)),
        })
    )
    return extended.select(
        *info.columns, "upgrade", "up_count", "avg_up_amt", "tot_up_amt", "cash_type", "cash_count", "avg_cash_amt",
        "tot_cash_amt", "region", "region_1", "region_2", "region_3", "cross_sell", "avg_oo_gift_band", "oo_count",
    )


def rg_channel_groups(df: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Four groupings of the recruiting channel ``channel_t``."""
    channel = F.col("channel_t")
    return df.withColumns({
        "channel_g1": classify(vocab.rg_channel_g1, otherwise=channel),
        "channel_g2": classify(vocab.rg_channel_g2, otherwise=channel),
        "channel_g3": classify(vocab.rg_channel_g3, otherwise=vocab.rg_channel_g3_default),
        "channel_g4": classify(vocab.rg_channel_g4, otherwise=channel),
    })


def rg_profile(addons: DataFrame, year: Period, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """The profile: donors, ages and amounts by sixteen dimensions."""
    dimensions = [
        "year", "channel_g2", "channel_g3", "channel_g4", "channel_t", "gift_band", "age_band", "gender", "region_3",
        "email_opt", "mail_opt", "mvd_gb", "upgrade", "cross_sell", "life_year", "cash_type",
    ]
    return (
        rg_channel_groups(addons, vocab=vocab)
        .withColumns({
            "year": F.lit(year.label),
            "life_year": F.col("life_year_band"),
            "cash_type": F.coalesce("cash_type", F.lit("No_cash_donor")),
        })
        .groupBy(*dimensions)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("age").alias("tot_avg_age"),
            F.sum("gift_amount").cast("decimal(38,2)").alias("tot_gift_amt"),
            F.sum("avg_up_amt").cast("decimal(38,0)").alias("avg_up_amt"),
            F.sum("avg_cash_amt").cast("decimal(38,0)").alias("avg_cash_amt"),
        )
    )


def rg_profile_rows(profile: DataFrame) -> DataFrame:
    """The profile in the types of the stored table."""
    return (
        profile.withColumn("year", F.col("year").cast("bigint"))
        .withColumn("avg_gift_amt", whole_number(F.col("tot_gift_amt")))
        .drop("tot_gift_amt")
        .withColumns({"avg_up_amt": F.col("avg_up_amt").cast("string"),
                      "avg_cash_amt": F.col("avg_cash_amt").cast("string")})
    )


def rg_profile_outliers(
    stored: DataFrame, year: Period, rules: Sequence[Mapping[str, Any]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) rows of the stored profile; by default the two impossible pledge sums found online."""
    if rules is None:
        # Amounts keyed in by mistake.
        rules = [{"channel_g2": "ONLINE", "avg_gift_amt": 1000000000}, {"channel_g2": "ONLINE", "avg_gift_amt": 9999999}]
    return split_outliers(stored, [{"year": year.year_number, **rule} for rule in rules])


def income_control_totals(income: DataFrame) -> DataFrame:
    """Distinct donors and rounded mean gift of the uploaded income file, to check an upload against."""
    return income.agg(
        F.countDistinct("donor_no").alias("unique_donors"),
        F.round(F.avg(_spend())).cast("decimal(38,0)").alias("avg_donation"),
    )
