"""Every query against its SQL, on the smallest tables; test_proofs.py holds the others."""

import pytest

from tidewell.plans import basics, correlograms, inference, regressions  # noqa: F401
from tidewell.plans.catalog import QUERIES, SQL

@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(name, QUERIES[name], SQL[name])


def test_every_other_query_has_a_proof():
    """By its full name in one of the other test files."""
    import pathlib

    here = pathlib.Path(__file__)
    proofs = "".join(f.read_text() for f in here.parent.glob("*.py") if f != here)
    assert [q for q in sorted(set(QUERIES) - set(SQL)) if f'"{q}"' not in proofs] == []


def test_entry_is_importable():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
