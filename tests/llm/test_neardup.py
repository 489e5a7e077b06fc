import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from meridia.llm import neardup
from meridia.llm.graph import components, least_reached
from tests.llm.helpers import docs, prose, rows


def _texts():
    rng, texts = random.Random(5), {}
    for family in range(12):
        base = prose(family, rng.choice([12, 60, 200]), 5000)
        for copy in range(rng.choice([1, 2, 5, 9])):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.02, 0.04, 0.06]))):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            texts[len(texts)] = " ".join(own)
    texts |= {500: None, 501: "", 502: " \n\t", 503: "one", 504: "ONE", 505: "one two", 506: " ", 507: " ".join(prose(99, 20_000))}
    shared = " ".join(prose(77, 60))
    texts |= {600 + k: shared + " " + " ".join(prose(1000 + k, 60, 10**6)) for k in range(40)}
    return texts


@pytest.mark.parametrize("options", [{}, {"most_list": 3, "most_group": 300}, {"words": 5}, {"long": 0}])
def test_against_brute_force(spark, options, monkeypatch):
    texts, options = _texts(), dict(options)
    if (long := options.pop("long", None)) is not None:
        monkeypatch.setattr(neardup, "LONG", -(10**9))  # every list carries the other pairs
    found = neardup.near_duplicates(docs(spark, texts), **options)
    want = neardup.brute({k: v and v.encode() for k, v in texts.items()}, options.get("words", 4))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_a_large_family_is_one_component_without_all_pairs():
    sets, rng = [], random.Random(1)
    base = rng.sample(range(10**9), 200)
    for _ in range(300):
        own = list(base)
        for _ in range(rng.choice([1, 5, 12, 60])):
            own[rng.randrange(200)] = rng.randrange(10**9)
        sets.append(np.unique(np.array(own, dtype=np.uint64)))
    pairs = neardup.linked(sets, 80)
    assert len(pairs) < 300
    least = list(range(300))

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        least[max(top(a), top(b))] = min(top(a), top(b))
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert top(i) == top(j)


def test_empty_repeated_null_and_extra_columns(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    many = docs(spark, [(3, "a b c d e", 1), (3, "a b c d e", 1), (1, "a b c d e", 2), (None, "a b c d e", 3), (None, None, 4)], "doc_id bigint, text string, kept int")
    assert rows(neardup.near_duplicates(many), "doc_id", "component_id", "kept") == [(1, 1, True), (3, 1, False), (3, 1, False), (None, 1, False), (None, None, True)]
    # the null id's row is a copy of row 1 and goes; the empty one stays
    assert rows(neardup.keep_one(many), "doc_id", "kept") == [(1, 2), (None, 4)]


def test_rows_that_share_an_id_or_have_none_are_judged_by_row(spark):
    a, b = " ".join(prose(1, 60, 5000)), " ".join(prose(2, 60, 5000))
    c, d = " ".join(prose(3, 60, 5000)), " ".join(prose(4, 60, 5000))
    near_b, near_c, near_d = b + " end", "start " + c, d + " end"
    table = docs(spark, [(3, a), (5, b), (5, a), (8, near_b), (None, c), (None, near_c), (None, c), (9, near_d), (None, d), (4, ""), (4, ""), (None, "x y"), (6, "x y")]).repartition(3)
    kept = rows(neardup.keep_one(table), "doc_id", "text")
    one_of_c = [r for r in kept if r[1] in (c, near_c)]
    assert len(one_of_c) == 1 and sorted([r for r in kept if r not in one_of_c], key=repr) == sorted([(3, a), (5, b), (9, near_d), (4, ""), (4, ""), (6, "x y")], key=repr)
    found = rows(neardup.near_duplicates(table), "doc_id", "component_id", "kept")
    assert found == sorted([(3, 3, True), (5, 5, True), (5, 3, False), (8, 5, False), *[(None, None, True)] * 3, (9, 9, True), (None, 9, False), (4, 4, True), (4, 4, True), (None, 6, False), (6, 6, True)], key=repr)


@pytest.mark.parametrize("alike", [False, True])
def test_a_list_of_many_classes_takes_bounded_time(spark, tmp_path, alike):
    n, rng = 100_000, np.random.default_rng(6)
    bits = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    others = rng.integers(0, 1 << 32, (n, neardup.K - neardup.T + 2), dtype=np.uint32)
    if alike:
        bits[:], others[:, :20] = bits[0], others[0, :20]
    twins = [(k, k + 50_000) for k in range(0, 50_000, 500)]
    for x, y in twins:
        bits[y], others[y, 3] = bits[x], others[x, 3]
    path = f"{tmp_path}/posted.parquet"
    pq.write_table(
        pa.table({"list": np.full(n, 77), "block": pa.array(np.zeros(n), pa.int32()), "node": np.arange(n), "n": np.full(n, 50), "low": bits[:, 0].view(np.int64), "high": bits[:, 1].view(np.int64), "others": pa.array([o.tobytes() for o in others], pa.binary())}),
        path,
    )
    began = time.perf_counter()
    found = rows(neardup._merged(spark.read.parquet(path), 80), "a", "b")
    assert time.perf_counter() - began < 60
    assert len(found) == n - 1 if alike else sorted(tuple(sorted(f)) for f in found) == twins


def test_a_group_of_unlike_sets_with_much_in_common_takes_bounded_time():
    rng = np.random.default_rng(8)
    frame = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([frame, rng.integers(0, 1 << 62, 40, dtype=np.uint64)])) for _ in range(20_000)]
    for k in range(0, 20_000, 1000):
        sets[k + 1] = np.unique(np.concatenate([sets[k][:95], sets[k + 1][:5]]))
    began = time.perf_counter()
    assert sorted(neardup.linked(sets, 80)) == [(k, k + 1) for k in range(0, 20_000, 1000)]
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("local", [7, 10**6])
def test_components_of_chains_and_stars(spark, local):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    found = rows(components(spark.createDataFrame(links, "a bigint, b bigint"), local=local), "node", "component")
    assert found == sorted([(k, 0) for k in range(61)] + [(k, 100) for k in range(100, 160)] + [(200, 200), (201, 200)], key=repr)


def test_local_components_of_random_graphs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        least = {int(x): int(x) for x in [*a, *b]}
        for _ in range(60):
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        nodes, found = least_reached(a, b)
        assert dict(zip(nodes.tolist(), found.tolist())) == least
