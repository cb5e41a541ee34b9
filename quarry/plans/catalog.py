"""All queries of the library by name, with the SQL that says the same."""

from __future__ import annotations

from quarry.plans import decoding, ledger, records, texts

MODULES = (decoding, ledger, records, texts)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
