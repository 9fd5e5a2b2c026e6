"""All named queries of the library and their SQL twins."""

from quern.plans import files, pages, panels, relational, texts  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES  # noqa: F401
