"""The gift before each gift, and the time between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import Stage, as_of_previous
from ..vocab import ONE_OFF


def prior_gift_of_every_gift(transactions: DataFrame, stage: Stage) -> DataFrame:
    """Each one-off gift with its donor's latest one-off gift of an earlier day (of that day, the highest id), and the days between.

    The yearly profile asks this of each donor's first gift of the year only. A gift without donor or date has no earlier one.
    """
    gifts = transactions.filter(F.col("payment_type") == ONE_OFF).select("donor_no", "tran_uid", "send_date", "tran_amount")
    prior = {"tran_uid": "prior_uid", "send_date": "prior_date", "tran_amount": "prior_amount"}
    found = as_of_previous(gifts, gifts, "donor_no", "send_date", "send_date", ["tran_uid", "tran_amount"], prior, stage)
    return found.withColumn("days_since", F.datediff("send_date", "prior_date"))
