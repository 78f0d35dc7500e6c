"""Driver queries and the SQL they are checked against."""

from lapwise.contract import scans, predicates, joins, aggregates, ordering, text, workloads, streams  # noqa: F401
from lapwise.contract.base import ORACLES, QUERIES  # noqa: F401
