from .asof import as_of_previous
from .joins import follow_merges, sieved, with_lookup, with_membership
from .quality import duplicate_keys, require_unique, split_outliers
from .ranking import first_per_key, ordinal
from .staging import RunFolder, Stage, as_is, shared_folder, staged

__all__ = ["RunFolder", "Stage", "as_is", "as_of_previous", "duplicate_keys", "first_per_key", "follow_merges", "ordinal", "require_unique", "shared_folder",
           "sieved", "split_outliers", "staged", "with_lookup", "with_membership"]
