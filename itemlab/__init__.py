"""itemlab: dataset audit, de-duplication, splitting and classifier evaluation on Spark tables."""

from itemlab.config import Defaults

__all__ = ["Defaults"]
