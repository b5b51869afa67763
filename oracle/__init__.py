"""DuckDB statements that recompute every query from the base tables, written apart from the Spark code."""

from .flow import FLOW
from .mail import MAIL
from .scores import SCORES
from .web import WEB


def oracle_sql() -> dict[str, str]:
    return {**MAIL, **WEB, **SCORES, **FLOW}
