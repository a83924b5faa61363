from checks.base import CHECKS
from checks import reading, analytics, features, models, scenarios, streams, ingest  # noqa: F401  (register checks)

__all__ = ["CHECKS"]
