"""All queries outside of the subpackage for text corpora, and their SQL."""

from turnmill.plans import delivery, lifecycle, logs, p1, p4, reference, retrieval, usage  # noqa: F401

QUERIES = p1.QUERIES | p4.QUERIES | reference.QUERIES
SQL = p1.SQL | p4.SQL | reference.SQL
