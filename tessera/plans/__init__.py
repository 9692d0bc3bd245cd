"""Registered queries over the test tables, each with the SQL that a second engine answers the same way."""

from __future__ import annotations

from tessera.plans import constructs, core, domain, people, views


def all_queries() -> dict:
    return core.queries() | domain.queries() | people.queries() | views.queries() | constructs.queries()


def all_oracles() -> dict:
    return core.oracles() | domain.oracles() | people.oracles() | views.oracles() | constructs.oracles()
