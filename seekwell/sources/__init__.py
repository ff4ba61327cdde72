from seekwell.sources.tables import SCHEMAS, read_table, spread, stream_table

__all__ = ["SCHEMAS", "read_table", "spread", "stream_table"]
