from cohortlens.sources.fixtures import Tables  # noqa: F401
from cohortlens.sources.readers import (  # noqa: F401
    scan_enrolments, scan_sites, scan_clicks, scan_table, scan_pruned,
)
