"""SQL for those queries that SQL can express."""

ORACLE: dict[str, str] = {}
