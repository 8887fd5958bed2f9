"""Registration of queries, and what their SQL has in common."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registered:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.oracles[query.__name__] = sql
            return query

        return put


#: Lines of the documents table, as sources.readers.lines gives them.
LINES = """lines AS (
  SELECT doc_id, CAST(i AS BIGINT) AS line_no, a[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(generate_series(1, len(a))) AS t(i))"""
#: White space at the ends, as functions.text.strip takes it.
STRIP = r"regexp_replace({}, '^[\s\x{{3000}}\x{{00A0}}]+|[\s\x{{3000}}\x{{00A0}}]+$', '', 'g')"


def stripped(column: str) -> str:
    return STRIP.format(column)
