from panelscope.sources.schema import SCHEMAS, TABLE_NAMES
from panelscope.sources.tables import Tables, load_catalog, load_tables, write_layout, write_tables

__all__ = ["SCHEMAS", "TABLE_NAMES", "Tables", "load_catalog", "load_tables", "write_layout", "write_tables"]
