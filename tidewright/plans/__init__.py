"""View declarations and what is derived from them: plans, classes, column types."""

from .compile import live, live_state, shown
from .spec import Join, Relation, ViewSpec

__all__ = ["Join", "Relation", "ViewSpec", "live", "live_state", "shown"]
