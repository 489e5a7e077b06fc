import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meridia.llm import decontaminate as dc
from meridia.llm.suffix import SuffixArray
from tests.llm.helpers import docs, prose, rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=12), st.sampled_from([4, 1 << 12, 1 << 20]))
def test_suffix_array_finds_every_place(ids, query, vocab):
    # a larger vocabulary puts fewer words into a key, so searches take more rounds
    array = SuffixArray(np.array(ids, dtype=np.int64), vocab, len(query))
    lo, hi = array.find(np.array(query), np.array([0]), np.array([len(query)]))
    places = sorted(array.order[lo[0] : hi[0]].tolist())
    assert places == [k for k in range(len(ids) - len(query) + 1) if ids[k : k + len(query)] == query]
    size, lo, hi = array.longest(np.array(query), np.array([0]), np.array([len(query)]))
    best = max((n for n in range(len(query) + 1) if any(ids[k : k + n] == query[:n] for k in range(len(ids) - n + 1)) or n == 0), default=0)
    assert size[0] == best
    want = [k for k in range(len(ids) - best + 1) if best and ids[k : k + best] == query[:best]]
    assert sorted(array.order[lo[0] : hi[0]].tolist()) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), max_size=5), st.lists(st.lists(st.integers(1, 3), max_size=8), max_size=4), st.integers(1, 5))
def test_hits_of_a_shard_are_those_of_brute_force(texts, items, window):
    said = lambda words: " ".join("abc"[w - 1] for w in words).encode()
    flags, found = dc.shard_hits([dc.item_words(said(t)) for t in texts], dc.Items([(str(k), said(i)) for k, i in enumerate(items)], window))
    want = dc.brute({k: said(t) for k, t in enumerate(texts)}, {k: said(i) for k, i in enumerate(items)}, window)
    assert {k: (len(f), int(f.sum()), sorted(o)) for k, (f, o) in enumerate(zip(flags, found))} == want


def _case():
    item = prose(1, 30)
    long = prose(2, 30_000)
    long[29_000:29_020] = item[5:25]
    return {
        1: " ".join(prose(3, 40)), 2: " ".join(prose(4, 20) + item[:13] + prose(5, 20)), 3: " ".join(item), 4: " ".join(prose(6, 300) + item[:12]),
        5: None, 6: "", 7: "short Item!", 8: "  a SHORT,item. ", 9: " ".join(long), 10: " ".join(item[:14]).upper(), 11: "été été naïve " * 20, 12: "...",
    }, {1: " ".join(item), 2: "short item", 3: None, 4: "", 5: "été " * 15, 20: " ".join(item[10:]), 3000: "!!"}


def test_against_brute_force(spark):
    texts, items = _case()
    found = dc.digest(dc.contamination(docs(spark, texts), docs(spark, items, "item_id bigint, text string")))
    want = dc.brute({k: v and v.encode() for k, v in texts.items()}, {k: v and v.encode() for k, v in items.items()})
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    assert got == {k: (n, h, len(i), dc.sha256(sorted(i)), h > 0 and 20 * h >= n) for k, (n, h, i) in want.items()}
    assert got[9][1] > 0 and not got[9][4] and got[8][4]


def test_blocks_of_items_give_the_same(spark):
    texts, items = _case()
    bench = docs(spark, items, "item_id bigint, text string")
    one = dc.digest(dc.contamination(docs(spark, texts), bench))
    many = dc.digest(dc.contamination(docs(spark, texts), bench, block_words=40))
    assert rows(one, *one.columns) == rows(many, *one.columns)


def test_longest_matches_and_places(spark):
    texts, items = _case()
    found = dc.longest_matches(docs(spark, texts), docs(spark, items, "item_id bigint, text string"))
    assert (3, "1", 0, 30, 0) in rows(found, "doc_id", "item_id", "item_word", "n_words", "doc_word")
    assert (9, "1", 5, 20, 29_000) in rows(found, "doc_id", "item_id", "item_word", "n_words", "doc_word")


def test_empty_tables_repeated_rows_and_clashing_columns(spark):
    none = docs(spark, [], "item_id bigint, text string")
    texts = docs(spark, [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None)], "doc_id bigint, text string, n_words int, item_id string")
    assert dc.remove_contaminated(texts, none).columns == texts.columns
    assert dc.remove_contaminated(texts, none).count() == 3
    bench = docs(spark, [(7, "a b"), (7, "a b"), (None, "a b")], "item_id bigint, text string")
    assert rows(dc.remove_contaminated(texts, bench), "doc_id", "item_id") == [(None, None)]
    assert rows(dc.digest(dc.contamination(texts, bench)), "doc_id", "n_hit", "n_items") == [(1, 2, 2), (1, 2, 2), (None, 0, 0)]
    assert dc.contamination(texts.limit(0), bench).count() == 0
