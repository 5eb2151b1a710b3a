"""rowloom: ordered data steps, procedures and SQL, planned onto Spark DataFrames."""

from rowloom.session import Session

__version__ = "0.1.0"
__all__ = ["Session"]
