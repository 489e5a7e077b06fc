"""License notices: names of other licenses, and neighbours."""

import pytest

from meridia.llm import license


@pytest.mark.parametrize(
    "text",
    ["released under the bsd license", "released under the gpl license", "licensed under the bsd license", "licensed under cc by nd 4 0"],
)
def test_another_license_is_not_this_one(text):
    assert license.scan(f"one two {text} three".encode())["labels"] == ""


def test_one_wrong_letter_in_a_name_is_still_found():
    assert license.scan(b"one released under the mot licence two")["labels"] == "mit"


def test_neighbouring_notices_are_all_reported():
    row = license.scan(b"released under the mot licence released under the mit license")
    assert [(s["first_word"], s["last_word"], s["errors"]) for s in row["spans"]] == [(0, 4, 2), (5, 9, 0)]
    many = license.scan(b"released under the mot licence " * 3)
    assert [s["first_word"] for s in many["spans"]] == [0, 5, 10]
