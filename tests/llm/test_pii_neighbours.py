"""Personal values that stand next to other numbers."""

import pytest

from meridia.llm import pii

KEY = b"test"


@pytest.mark.parametrize(("other", "kind"), [("190.137.223.204", "ip"), ("1999-12-31", "date"), ("4539 1488 0343 6467", "card"), ("1234@mail.example.com", "email")])
def test_a_phone_ends_before_another_value(other, kind):
    phone = "+1 (826) 555-4081"
    new, counts = pii.replace(f"Call {phone} {other}.", KEY)
    assert counts == {"phone": 1, kind: 1}
    assert new == f"Call {pii.replace(phone, KEY)[0]} {pii.replace(other, KEY)[0]}."


def test_long_dotted_phones_are_still_found():
    assert pii.replace("+33.12.34.56.78", KEY)[1] == {"phone": 1}
