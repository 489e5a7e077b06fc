"""Operators over whole tables: url filters, sharding, LM scoring, the pipeline."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from meridia.llm import bpe, decontaminate, neardup, pii, quality, sharding, urls
from meridia.llm import catalog
from tests.llm.helpers import docs, prose, rows

# --- url filters


def _verdict(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in __import__("re").match(r"[^/?#]*", rest)[0])
    path = __import__("re").match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else urls.DEFAULT


URLS = [
    None, "", "no scheme/en/", "http://", "https://COM/en/", "http://a.com/en", "http://a.com/en/", "http://example.com/en/7198?x#y", "http://x.Example.com/en/71", "http://notexample.com/en/7", "http://example.com./en/7",
    "http://example.net/de/8", "ftp://b.example.net/de/9", "http://net/de/?q", "http://org#/es/", "http://w.org/es/1", "http://a..com/en/" + "z" * 5000, "http://" + "a." * 3000 + "com/en/1", "x://y://z.com/en/", "http://com", "http://a.com?/en/", "http://ünï.com/en/ß",
]
RULE_SETS = [urls.RULES, (), (("block", "com", ""), ("allow", "com", ""), ("allow", "a.com", "/e"), ("block", "a.com", "/en/"), ("block", "example.com", "/"), ("allow", "", ""))]


@pytest.mark.parametrize("rules", RULE_SETS)
def test_urls_against_brute_force(spark, rules):
    pages = docs(spark, [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[7]), (None, URLS[7])], "page_id bigint, url string")
    want = [(k, *_verdict(u, [r for r in rules if r[1]])) for k, u in [*enumerate(URLS), (0, URLS[7]), (None, URLS[7])]]
    found = urls.verdicts(pages, urls.rules_table(spark, [r for r in rules if r[1]]))
    assert rows(found, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)


@pytest.mark.parametrize("size", [7, 10**6])
def test_urls_many_rules_spread_over_ranges_and_buckets(spark, monkeypatch, size):
    monkeypatch.setattr(urls, "BUCKET", 50)
    monkeypatch.setattr(urls, "RANGE", size)
    rules = [("block" if k % 3 else "allow", f"h{k % 7}.com", f"/p{k}"[: 2 + k % 3]) for k in range(60)] + [("block", "com", "/p")]
    table = [(k, f"http://s{k % 5}.h{k % 9}.com/p{k}") for k in range(400)]
    found = urls.verdicts(docs(spark, table, "page_id bigint, url string"), urls.rules_table(spark, rules))
    assert rows(found, "page_id", "host", "path", "rule", "verdict") == sorted([(k, *_verdict(u, rules)) for k, u in table], key=repr)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert urls.verdicts(docs(spark, [], "page_id bigint, url string"), urls.rules_table(spark)).count() == 0


# --- sharding


@pytest.mark.parametrize(("n", "shards"), [(0, 4), (3, 5), (100, 7), (1003, 10)])
def test_shards_differ_by_one_row_at_most(spark, n, shards):
    table = docs(spark, [(k if k % 5 else 7, f"text {k}" if k % 3 else None) for k in range(n)]).repartition(3)
    found = sharding.assign(table, shards=shards, virtual=8).collect()
    assert len(found) == n
    count = Counter(r["shard"] for r in found)
    if n:
        sizes = [count.get(s, 0) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    for s in count:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(count[s]))
    want = Counter((k if k % 5 else 7, len(f"text {k}") + 16 if k % 3 else 16, zlib.crc32(f"text {k}".encode()) if k % 3 else 0) for k in range(n))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in found)


def test_ring_owner_and_limited_movement(spark):
    found = sharding.assign(docs(spark, [(k, "x") for k in range(3000)]), shards=10, virtual=64).collect()
    places, owners = sharding.ring(10, 64)
    for r in found[:200]:
        key = int(sharding.key_places(np.array([r["doc_id"]]))[0])
        assert r["ring_shard"] == sharding.brute_owner(key, places.tolist(), owners.tolist())
    wanted = Counter(r["ring_shard"] for r in found)
    over = sum(max(0, n - 300) for n in wanted.values())
    assert sum(r["shard"] != r["ring_shard"] for r in found) == over  # none moves but overflow
    assert set(owners[np.isin(places, sharding.ring(11, 64)[0])]) == set(range(10))  # nodes of old shards stay


# --- the pipeline

SENTENCE = "Number {} of many sentences says {} and {} before it ends."


def _corpus():
    rng = __import__("random").Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {k: " ".join(SENTENCE.format(word(), word(), word()) for _ in range(6)) for k in range(8)}
    texts[20], texts[21] = texts[3], texts[4] + " Indeed."
    items = {0: " ".join(word() for _ in range(20)) + "."}
    texts[22] = texts[5].replace("many", "few") + " " + items[0]
    texts[23] = "Menu | Home | News | About\n" + texts[6].replace("says", "states").replace("ends", "stops") + " Call +1 (578) 555-6437 now."
    texts[24] = "BUY!! NOW!! " * 30
    texts[25] = None
    return texts, items


def _brute_pipeline(texts, items):
    kept = {}
    for k, t in texts.items():
        row = quality.judge(None if t is None else t.encode())
        if row[-2]:
            kept[k] = row[-1]
    component = neardup.brute({k: v.encode() for k, v in kept.items()}, corpus_pipeline.SHINGLE)
    kept = {k: v for k, v in kept.items() if component[k][1] == k}
    hits = decontaminate.brute({k: v.encode() for k, v in kept.items()}, {k: v.encode() for k, v in items.items()})
    kept = {k: v for k, v in kept.items() if not (hits[k][1] and 20 * hits[k][1] >= hits[k][0])}
    kept = {k: pii.replace(v, pii.EXAMPLE_KEY)[0] for k, v in kept.items()}
    encode = bpe.Encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return {k: encode.encode(v) for k, v in kept.items()}


def test_pipeline_against_brute_force(spark, tmp_path):
    texts, items = _corpus()
    docs(spark, [(k, v, "en", "src", len(v or "")) for k, v in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs(spark, items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = _brute_pipeline(texts, items)
    assert found == want and set(want) == {0, 1, 2, 3, 4, 5, 6, 7, 23}


def test_stages_keep_the_columns_and_take_an_empty_table(spark, tmp_path):
    docs(spark, [], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs(spark, [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).dtypes == table.dtypes, name
        assert stage(spark, table, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == 0


def test_stages_keep_columns_with_their_own_names(spark, tmp_path):
    docs(spark, [(1, "no such words here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = "Ten plain words stand in this line, and it ends well."
    table = docs(spark, [(1, good, 1, "a", "b", 5, 6)], "doc_id bigint, text string, n_chars int, quality string, pii string, contamination int, kept int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, table, str(tmp_path))
        assert found.dtypes == table.dtypes, name
        assert rows(found, "doc_id", "text", "quality", "pii", "contamination", "kept") == [(1, good, "a", "b", 5, 6)], name


def test_every_operator_is_registered():
    names = catalog.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
