from noticiario.operators import (
    columns,
    dedup,
    extract,
    filters,
    joins,
    listing,
    reports,
    sets,
)

__all__ = ["columns", "dedup", "extract", "filters", "joins", "listing", "reports", "sets"]
