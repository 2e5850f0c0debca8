"""Writers of the output formats."""
from .reports import (
    design_bundle_write, qc_report, qc_report_write, ranked_json_read, ranked_json_write, thresholds_table,
)

__all__ = ["design_bundle_write", "qc_report", "qc_report_write", "ranked_json_read", "ranked_json_write", "thresholds_table"]
