"""Registered queries, by theme; ``__spark_entry__`` assembles them."""

from queries import compare, documents, outcomes, runs

MODULES = (compare, outcomes, documents, runs)


def all_queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
