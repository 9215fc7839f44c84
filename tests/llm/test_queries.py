"""Every query of the subpackage is registered under its problem's name."""

from quillspan.llm import queries


def test_names():
    names = set(queries.queries())
    assert {f"p{n}_found" for n in range(1, 11) if n != 8} | {"p8_ids"} <= names
    assert set(queries.oracle_sql()) <= names
