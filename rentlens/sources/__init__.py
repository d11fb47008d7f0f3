from rentlens.sources.tables import TABLES, read_table, register_views  # noqa: F401
