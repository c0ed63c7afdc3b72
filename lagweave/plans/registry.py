"""All queries over the event streams, and their SQL twins."""

from lagweave.plans import more, sessions
from lagweave.plans.queries import QUERIES, SQL

FLAGSHIP = "ridge_dr2_1d"

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "more", "sessions"]
