from .catalog import Sources, conform
from .monthly_table import MonthlyTable
from .schemas import LOOKUP_KEYS, REPORTS, TABLES
from .sinks import append_period, create_or_replace, read_report, replace_folder, rewrite_without

__all__ = ["LOOKUP_KEYS", "REPORTS", "TABLES", "MonthlyTable", "Sources", "append_period", "conform", "create_or_replace", "read_report",
           "replace_folder", "rewrite_without"]
