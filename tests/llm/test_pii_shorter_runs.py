"""Card numbers and others that a longer run of digits hides."""

import pytest

from meridia.llm import pii

KEY = b"test"


@pytest.mark.parametrize(
    ("kind", "value"),
    [("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("card", "4111-1111-1111-1111"), ("iban", "BE68 5390 0754 7034")],
)
@pytest.mark.parametrize("after", [" 123", " 2027", " 12/27", " CALL"])
def test_the_longest_run_that_passes_counts(kind, value, after):
    new, counts = pii.replace(f"Pay {value}{after} now", KEY)
    assert counts == {kind: 1} and value not in new
    assert new == f"Pay {pii.pseudonym(kind, value, KEY)}{after} now"
