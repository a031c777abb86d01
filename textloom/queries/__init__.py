"""All queries by name, each with the SQL that gives the same rows."""

from textloom.queries import catalogue, inference, routing, sessions, texts, validation

QUERIES = {}
for _module in (texts, catalogue, routing, validation, sessions, inference):
    QUERIES.update(_module.QUERIES)
