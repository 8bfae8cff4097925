"""Table cleaning and profiling on Spark."""

from .operators.changes import changed_cells, changed_rows
from .operators.profile import diagnosis, full_profile, quality
from .plans.clean import Cleaned, clean
from .plans.pipeline import run_pipeline
from .plans.prepare import Prepared, prepare
from .plans.treat import Treated, treat
from .sources.readers import read_csv, read_file, read_json, read_parquet
from .sources.writers import write_csv, write_json

__all__ = [
    "Cleaned", "Prepared", "Treated", "changed_cells", "changed_rows", "clean", "diagnosis", "full_profile",
    "prepare", "quality", "read_csv", "read_file", "read_json", "read_parquet", "run_pipeline", "treat",
    "write_csv", "write_json",
]
