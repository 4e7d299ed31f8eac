"""End-to-end jobs (prepare, indicators, wide row, modelling) and their fixed settings."""
