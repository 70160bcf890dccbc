"""Tables of spans and signals, as files and as views."""

from spanwise.sources.tables import TABLES, read_checked, read_spans, register_tables, write_spans

__all__ = ["TABLES", "read_checked", "read_spans", "register_tables", "write_spans"]
