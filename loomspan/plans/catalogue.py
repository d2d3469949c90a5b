"""The named queries over the operators of this engine, each with its SQL."""

from __future__ import annotations

from loomspan.plans import candidates, census, estimation, linkage, panels, people, relational, texts  # noqa: F401
from loomspan.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "shift_share_z"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
