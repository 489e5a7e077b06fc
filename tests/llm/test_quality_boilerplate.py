"""Boilerplate phrases within clean lines."""

import pytest

from meridia.llm import quality

CLEAN = "Many readers found the old building quiet and rather pleasant on a long winter day."


@pytest.mark.parametrize("place", ["The catalog in the hall was new.", "Her blog in print sold well.", "They spread more butter.", "You must log in before you read more of it."])
def test_a_clean_line_stays(place):
    row = quality.judge(f"{CLEAN} {place}".encode())
    assert row[8] == 0 and row[-2] and row[-1] == f"{CLEAN} {place}"


@pytest.mark.parametrize("line", ["All rights reserved.", "Copyright 2020 Example. All rights reserved.", "Read more: click here."])
def test_a_boilerplate_line_goes(line):
    row = quality.judge(f"{CLEAN}\n{line}".encode())
    assert row[8] == 1 and row[-1] == CLEAN
