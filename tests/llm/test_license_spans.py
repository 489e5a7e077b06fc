"""License notices against edit distance, and long texts of nothing but notices."""

import random
import time

import pytest

from meridia.llm import license


def _nearest(notice, text):
    """The least edit distance of the notice to any stretch of the text, row by row."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(notice, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def _damaged(notice, errors, rng):
    """The notice with errors outside the names that it needs."""
    words = notice.split(" ")
    for _ in range(errors):
        k = rng.choice([k for k, w in enumerate(words) if w not in license.NAMES and len(w) > 2])
        w, at = words[k], rng.randrange(len(words[k]))
        words[k] = rng.choice([w[:at] + "q" + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "q" + w[at:]])
    return " ".join(words)


@pytest.mark.parametrize("seed", range(25))
def test_every_planted_notice_is_found_with_its_distance(seed):
    rng, text, planted, word = random.Random(seed), [], [], 0
    for _ in range(8):
        noise = [rng.choice(["zz7", "xyx", "kk", "vwv9"]) for _ in range(rng.randrange(3, 9))]
        text += noise
        word += len(noise)
        k = rng.randrange(len(license.NOTICES))
        notice, label = license.NOTICES[k]
        said = _damaged(notice, rng.randrange(license.errors_of(notice) + 1), rng)
        others = [x for x in range(len(license.NOTICES)) if _nearest(license.NOTICES[x][0], said) <= license.errors_of(license.NOTICES[x][0])]
        if others == [k]:  # two notices that are near the same words have a test of their own
            planted.append((label, word, word + len(said.split(" ")) - 1, _nearest(notice, said)))
            text.append(said)
            word += len(said.split(" "))
    row = license.scan(" ".join([*text, "zz"]).encode())
    assert [(s["label"], s["first_word"], s["last_word"], s["errors"]) for s in sorted(row["spans"], key=lambda s: s["first_word"])] == planted


@pytest.mark.parametrize("unit", ["released under the mit license ", "released under the mot licence ", "x under the license of ", "licensed under cc by 4 0 "])
def test_long_texts_of_notices_take_linear_time(unit):
    def seconds(n):
        license._matches.cache_clear()
        began = time.perf_counter()
        license.scan(unit.encode() * n)
        return time.perf_counter() - began

    seconds(10)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.02)


def test_an_earlier_damaged_notice_is_not_lost():
    row = license.scan(b"released under the mit licence xx released under the mit license")
    assert [(s["first_word"], s["last_word"], s["errors"]) for s in row["spans"]] == [(0, 4, 1), (6, 10, 0)]
