"""Every operator as a registered query, with the SQL that checks it."""

from pagewatch.catalog import history, people, scalars, site, web  # noqa: F401
from pagewatch.catalog.core import CASES, query

__all__ = ["CASES", "query"]
