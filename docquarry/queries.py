"""Every query of the library and its SQL, by name."""

from docquarry.plans import documents, evaluation, operations, records, scalars, storage, streams, validation  # noqa: F401
from docquarry.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
