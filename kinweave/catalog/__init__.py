"""The registered queries on the driver's tables, and the SQL each is checked against."""

from kinweave.catalog.oracles import ORACLES
from kinweave.catalog.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
