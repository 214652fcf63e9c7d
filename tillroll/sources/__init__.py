"""Sources, schema detection and sinks."""
from .schema import (REQUIRED_COLUMNS, OPTIONAL_COLUMNS, COLUMN_ALIASES, CLEAN_SCHEMA,
                     MissingColumnsError, detect, resolve_mapping, order_key)
from .reader import detect_charset, read_csv, read_parquet, read_sales, source_shape
from .writer import write_table, export_clean, export_products
