"""All queries of the library, by name."""

from lorespark.queries import graph, records, search, streams, text
from lorespark.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "graph", "records", "search", "streams", "text"]
