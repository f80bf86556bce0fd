"""Analytics over task sets, candidate banks and run logs, declared as Spark plans."""

from evalmill.session import checkpoint_dir, session, table

__all__ = ["checkpoint_dir", "session", "table"]
