"""All queries of the library, with their SQL."""

from __future__ import annotations

from shutterlake.plans import business, culling, gallery, imaging, lifecycle, pixels, studio, vision  # noqa: F401  they register their queries
from shutterlake.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
