"""Sources: typed CSV/Parquet/text readers, line parsing with rejects, spec files."""

from featloom.sources.text import parse_delimited, read_lines, field_count
from featloom.sources.csv import (read_users, read_clicks, read_orders, read_loans, read_loan_sums,
                                  read_csv_table)
from featloom.sources.parquet import load_table
from featloom.sources.specs import read_column_names, read_feature_spec, read_dictionary

__all__ = ["parse_delimited", "read_lines", "field_count", "read_users", "read_clicks", "read_orders",
           "read_loans", "read_loan_sums", "read_csv_table", "load_table", "read_column_names",
           "read_feature_spec", "read_dictionary"]
