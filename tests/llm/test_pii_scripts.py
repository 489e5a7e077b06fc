"""Personal values among other scripts, and values planted in random texts."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridia.llm import pii

KEY = b"test"
ARABIC = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
VALUES = {
    "card": ["4539 1488 0343 6467", "4539148803436467"], "phone": ["+1 (578) 555-6437", "+49 30 1234567"[:13]], "ip": ["97.51.17.173"], "email": ["a.71@mail0.example.com", "x@y.org"],
    "date": ["1999-12-31", "03.04.2001"], "ssn": ["123-45-6789"], "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"], "iban": ["DE89 3704 0044 0532 0130 00"],
}


@pytest.mark.parametrize("kind", sorted(set(VALUES) - {"secret", "email"}))
def test_digits_of_other_scripts_are_no_values(kind):
    for value in VALUES[kind]:
        foreign = value.translate(ARABIC)
        for text in (foreign, value[0] + foreign[1:], foreign[:-1] + value[-1], f"1 {foreign}", f"1{foreign} 2"):
            assert pii.replace(text, KEY) == (text, {}), text


def test_a_digit_and_many_foreign_ones():
    for text in ("1" + "١" * 14, "1 ١٢٣-٤٥-٦٧٨٩", "+1 ٢٢٢ ٥٥٥ ٦٦٧٧", "1.٢.3.٤"):
        assert pii.replace(text, KEY) == (text, {})


@pytest.mark.parametrize("local", ["иван", "²³", "王小明", "أحمد", "été", "Ωmega7", "a_b"])
def test_email_names_of_any_script_are_replaced_reversibly(local):
    new, counts = pii.replace(f"to {local}@example.com now", KEY)
    assert counts == {"email": 1} and f" {local}@" not in new and re.fullmatch(r"to [\w.+-]+@example\.com now", new)
    assert len(new) == len(f"to {local}@example.com now")
    assert len({pii.pseudonym("email", f"{local}{k}@x.org", KEY) for k in range(50)}) == 50


def test_a_name_of_marks_alone_stays_and_is_not_counted():
    assert pii.replace("_+@x.org", KEY) == ("_+@x.org", {})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0159١٢²½ +-.()/@abfAFDE\nи", max_size=60))
def test_any_text_is_taken(text):
    new, counts = pii.replace(text, KEY)
    assert (new == text) == (not counts) or counts  # a value may by chance stand for itself
    assert pii.replace(text, KEY) == (new, counts)


@pytest.mark.parametrize("seed", range(30))
def test_planted_values_and_nothing_else_are_replaced(seed):
    rng = random.Random(seed)
    words = ["said", "no 12", "at 7:30", "été", "v1.2", "(see", "below)", "3-4", "x@", "١٢", "100%", "\n"]
    parts, want, count = [], [], {}
    for _ in range(40):
        if rng.random() < 0.4:
            kind = rng.choice(sorted(VALUES))
            value = rng.choice(VALUES[kind])
            new = pii.pseudonym(kind, value, KEY)
            assert new is not None and new != value
            parts.append(value)
            want.append(new)
            count[kind] = count.get(kind, 0) + 1
        else:
            parts.append(rng.choice(words))
            want.append(parts[-1])
        parts.append(" and ")
        want.append(" and ")
    assert pii.replace("".join(parts), KEY) == ("".join(want), count)
