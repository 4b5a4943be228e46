"""S3: log type from the source file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_type_from_file(file_name: Column) -> Column:
    """``-dns`` in the name -> dns; else training/testing/validation -> deep_kernel;
    else standard_host. The order of the tests matters."""
    name = F.coalesce(file_name, F.lit(""))
    return (
        F.when(name.contains("-dns"), F.lit("dns"))
        .when(name.contains("training") | name.contains("testing") | name.contains("validation"),
              F.lit("deep_kernel"))
        .otherwise(F.lit("standard_host"))
    )
