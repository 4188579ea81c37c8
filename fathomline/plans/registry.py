"""Everything that the core registers."""

from . import problems, reference

FLAGSHIP = "ret11_search"
QUERIES = {**reference.QUERIES, **problems.QUERIES}
ORACLES = {**reference.ORACLES, **problems.ORACLES}
