"""All queries outside the subpackage for training data."""

from . import problem_sql, problems, reference, reference_sql, stores

QUERIES = {**reference.QUERIES, **stores.QUERIES, **problems.QUERIES}
ORACLES: dict[str, str] = {**reference_sql.ORACLES, **stores.ORACLES, **problem_sql.ORACLES}
