"""Operators that judge each row by itself: quality, licenses, PII, chat, BPE."""

import base64
import datetime
import hashlib
import re
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from meridia.llm import bpe, chat, license, pii, quality
from tests.llm.helpers import docs, prose, rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = {1: None, 2: "", 3: " \n\t ", 4: "\x00 é ß", 5: "a" * 50_000, 6: "word " * 30_000, 7: "\n" * 500, 8: "🙂🙂 ퟿"}


# --- quality rules


def _plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab #|!.\n\té\x0b", max_size=120))
def test_quality_counts(text):
    assert quality.judge(text.encode())[:5] == _plain_counts(text)


def test_quality_counts_of_odd_texts(spark):
    found = quality.digest(docs(spark, ODD))
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted([(k, *_plain_counts(v)) for k, v in ODD.items()], key=repr)
    assert not any(r["kept"] for r in found.collect())


def test_quality_rules_by_line():
    good = "This line has ten good words and it ends properly."
    assert quality.judge(good.encode())[-2]
    dirty = f"{good}\nHome | News | About | Contact\nWe use cookies: see our Privacy Policy.\nBUY!! NOW!! CHEAP!!\n{good[::-1]}x. end."
    row = quality.judge(dirty.encode())
    assert row[6:9] == (1, 1, 1) and row[-1].startswith(good) and "Home" not in row[-1] and "BUY" not in row[-1]
    unfinished = "A sentence ends here. And another one goes on without any end of its own"
    assert quality.judge(unfinished.encode())[-2]
    assert not quality.judge((good + "\n" + "a | b | c | d | e\n" * 20).encode())[-2]


def test_quality_clean_keeps_columns(spark):
    table = docs(spark, [(1, "Ten words stand in this line, which is clean enough.\nAll rights reserved.", 7, True), (2, None, 7, False), (1, "Ten words stand in this line, which is clean enough.\nAll rights reserved.", 7, True)], "doc_id bigint, text string, n_chars int, kept boolean")
    found = quality.clean(table)
    assert found.dtypes == table.dtypes
    assert rows(found, "doc_id", "text", "n_chars", "kept") == [(1, "Ten words stand in this line, which is clean enough.", 52, True)] * 2
    assert quality.clean(table.limit(0)).count() == 0


# --- licenses


def _places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), sorted((k, label) for phrase, label in license.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())


@pytest.mark.parametrize("text", [*ODD.values(), "MIT License mit license MIT-License", "submit license; Apache\nLICENSE. General public. License general Public license", "x " * 5000 + "mit license"])
def test_license_base_places(text):
    n, places = _places(text)
    row = license.scan(None if text is None else text.encode())
    assert (row["n_words"], row["n_base"]) == (n, len(places))
    assert row["first_word"] == (places[0][0] if places else None) and row["last_word"] == (places[-1][0] if places else None)
    assert row["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= row["score"] <= 1


def test_license_fuzzy_notices_with_spans():
    row = license.scan(b"one two Relesed undr the MIT Licence. more")
    assert row["base_labels"] == "" and row["labels"] == "mit" and 0.8 < row["score"] < 1
    assert [(s["first_word"], s["last_word"], s["errors"]) for s in row["spans"]] == [(2, 6, 3)]
    assert license.scan(b"released under the moon by my license")["labels"] == ""
    for notice, label in license.NOTICES:  # each with as many errors as it allows, spread out
        errors = license.errors_of(notice)
        wrong = list(notice)
        for k in range(errors):
            wrong[2 + k * (len(notice) - 3) // errors] = "q"
        assert label in license.scan("".join(wrong).encode())["labels"].split(","), notice


def test_license_tables(spark):
    assert license.digest(docs(spark, [])).count() == 0
    both = docs(spark, [(1, "MIT License", "x"), (1, "MIT License", "x"), (None, None, None)], "doc_id bigint, text string, labels string")
    assert rows(license.digest(both), "doc_id", "labels", "score") == [(1, "mit", 1.0), (1, "mit", 1.0), (None, "", 0.0)]


# --- PII

KEY = b"test"


@pytest.mark.parametrize("size", [2, 10, 97, 1000, 73049])
def test_feistel_is_a_permutation(size):
    top = min(size, 1000)
    if size == top:
        assert sorted(pii.permute(k, size, KEY, "t") for k in range(size)) == list(range(size))
    odd = [k for k in range(size) if k % 2][:200]
    moved = [pii.permute(k, size, KEY, "t", lambda x: x % 2 == 1) for k in odd]
    assert len(set(moved)) == len(odd) and all(m % 2 and m < size for m in moved)
    assert moved == [pii.permute(k, size, KEY, "t", lambda x: x % 2 == 1) for k in odd]


@pytest.mark.parametrize(
    ("kind", "value", "shape"),
    [("card", "4539 1488 0343 6467", r"\d{4} \d{4} \d{4} \d{4}"), ("card", "4539148803436467", r"\d{16}"), ("phone", "+1 (578) 555-6437", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("ip", "97.51.17.173", r"\d+\.\d+\.\d+\.\d+"),
     ("email", "éa.71@mail0.example.com", r"[à-þ][a-z]\.\d\d@mail0\.example\.com"), ("date", "1999-12-31", r"\d{4}-\d\d-\d\d"), ("date", "31/12/1999", r"\d\d/\d\d/\d{4}"), ("date", "03.04.2001", r"\d\d\.\d\d\.\d{4}"),
     ("ssn", "123-45-6789", r"\d{3}-\d\d-\d{4}"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962", r"[0-9a-f]{40}"), ("iban", "DE89 3704 0044 0532 0130 00", r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d")],
)
def test_pseudonyms_keep_format_and_links(kind, value, shape):
    text = f"Said {value}, and {value}."
    new, counts = pii.replace(text, KEY)
    assert counts == {kind: 2} and value not in new
    first, second = re.fullmatch(r"Said (.+), and (.+)\.", new).groups()
    assert first == second and re.fullmatch(shape, first)
    assert pii.pseudonym(kind, first, KEY) is not None  # still passes the check
    assert pii.replace(text, b"other")[0] != new


def test_pii_leaves_what_fails_its_check():
    for text in ("1234567812345678", "999.1.2.3", "1999-13-45", "000-12-3456", "a@b", "0" * 5, "version 1.2.3.4.5", None, "", "plain", "12345678901234567890123456789012345"):
        assert pii.replace(text, KEY) == (text, {})
    assert pii.luhn("4539148803436467") and datetime.date(2000, 1, 1).toordinal()


def test_pii_tables(spark):
    table = docs(spark, [(1, "call +1 (578) 555-6437", 22, "x"), (1, "call +1 (578) 555-6437", 22, "x"), (None, None, None, None)], "doc_id bigint, text string, n_chars int, email string")
    found = pii.remove(table, key=KEY)
    assert found.dtypes == table.dtypes and found.count() == 3 and len({r["text"] for r in found.collect()}) == 2
    assert rows(pii.pseudonymised(table, key=KEY).selectExpr("doc_id", "pii.phone AS n"), "doc_id", "n") == [(1, 1), (1, 1), (None, 0)]
    assert pii.remove(table.limit(0), key=KEY).count() == 0
    long = "x " * 200_000 + "a.1@b.example.com"
    assert pii.replace(long, KEY)[1] == {"email": 1}


# --- chat

NASTY = st.lists(st.sampled_from(["\\", "<", "|", ">", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|end|>", "<|turn|>", "<|body|>", "a", "\n", "é", " "]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_chat_round_trip(turns):
    made = [chat.format_turn(r, chat.parts_of(t)[:0] or [{"type": "text", "text": t}]) for r, t in turns]
    text = "".join(m[0] for m in made)
    assert [(r, t) for r, t, _, _ in chat.read_turns(text)] == turns
    for _, said in turns:
        for control in chat.CONTROL:
            assert control not in chat.escape(said)


def test_chat_digest(spark):
    table = spark.createDataFrame(
        [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, None, "tool", "\\<|end|>")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = rows(chat.digest(chat.with_probe(table)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    probe = "</s>[INST] ok [/INST]"
    want = [(1, 3, sha("user\na\nassistant\nb</s>\nassistant\n\n"), 5, sha("b</s>")), (2, 2, sha("\nx\n\nx\n"), 0, sha("")), (None, 1, sha("assistant\nn\n"), 1, sha("n")),
            (3, 1, sha("tool\n\\<|end|>\n"), 0, sha("")), (-1, 2, sha(f"user\n{probe}\nassistant\n{probe}\n"), 21, sha(probe))]
    assert found == sorted(want, key=repr)
    assert chat.digest(table.limit(0)).count() == 0


def test_chat_typed_parts(spark):
    content = '[{"type":"text","text":"see <|image:9|>"},{"type":"image","ref":"s3://a","tiles":2},{"type":"audio","ref":"b","seconds":3},{"type":"document","ref":"c","pages":1},{"type":"video","ref":"d"}]'
    row = chat.segments(spark.createDataFrame([(1, 0, "user", content)], "conv_id bigint, turn bigint, role string, text string"), typed=True).first()
    assert row["segment"] == "<|turn|>user<|body|>see <\\|image:9|><|image:0|><|audio:1|><|document:2|><|video:3|><|end|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "s3://a", 425), ("audio", "b", 79), ("document", "c", 508), ("video", "d", 0)]
    assert row["segment"][row["body_start"] : row["body_end"]].startswith("see")


# --- byte-level BPE

RANK_TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANK_TABLE, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(text):
    encode = bpe._encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    ids = encode.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY.encode_ordinary(text)
    assert encode.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_both_merges_agree(piece):
    encode = bpe._encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    assert encode._merge_short(piece) == encode._merge_long(piece)


TEXTS = st.lists(st.sampled_from(["word", " ", "  ", "\n", "'s", "'", "re", "7", "é", "!?", "　", "'ll", "x" * 30]), max_size=80).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(3, 12), st.integers(4, 20))
def test_bpe_chunks_stitch(text, chunk, overlap):
    encode = bpe._encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    join, out = bpe.Stitcher(encode), []
    for start, part, last in bpe.chunks_of(text, chunk, overlap):
        out.append(join.add(start, part, *bpe.pretokenised(encode, start, part), last))
    assert b"".join(out) == encode.encode(text)


def test_bpe_tables(spark):
    texts = ODD | {20: " ".join(prose(1, 5000)), 21: "x" * 3000 + " y" * 900, 22: " " * 4000 + "z"}
    found = bpe.digest(docs(spark, [*texts.items(), (20, texts[20]), (None, "null id")]), RANKS, public_tokenizers.PATTERN, chunk=1000, overlap=60)

    def want(doc, text):
        ids = LIBRARY.encode_ordinary(text or "")
        return doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert rows(found, *found.columns) == sorted([want(*x) for x in [*texts.items(), (20, texts[20]), (None, "null id")]], key=repr)
    back = bpe.decode(bpe.encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN, chunk=1000, overlap=60), RANKS)
    assert rows(back, "doc_id", "text") == sorted([(k, v or "") for k, v in texts.items()], key=repr)
    assert bpe.digest(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
