"""Reading CSV exports, record tables and change events."""

from recordmill.sources.csv import read_csv, read_csv_by_records  # noqa: F401
from recordmill.sources.records import modified_since, scan_pages  # noqa: F401
from recordmill.sources.tables import read_table  # noqa: F401
