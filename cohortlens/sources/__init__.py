from cohortlens.sources.buckets import buckets_for, read_bucketed, store_bucketed
from cohortlens.sources.sinks import export_csv, write_parquet, write_period, write_wide
from cohortlens.sources.tables import drop_all_null, read_csv, read_period, read_table, read_wide

__all__ = [
    "buckets_for", "drop_all_null", "export_csv", "read_bucketed", "read_csv", "read_period", "read_table", "read_wide",
    "store_bucketed", "write_parquet", "write_period", "write_wide",
]
