"""Chat: ties, malformed parts, and placeholders that were only said."""

import hashlib
import json

import pytest

from meridia.llm import chat

TABLE = "conv_id bigint, turn bigint, role string, text string"


def test_ties_go_by_the_text_itself(spark):
    texts = ["<]", "<|", "a", "a b", "a\\", "a<|end|>", "", "\n", "a\nb"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 0, None, "z"), (1, None, "user", "first")]
    row = chat.digest(spark.createDataFrame(rows, TABLE).repartition(3)).first()
    said = "user\nfirst\n" + "\nz\n" + "".join(f"user\n{t}\n" for t in sorted(texts))
    assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize(
    ("part", "segment", "tokens"),
    [({"type": "image", "tiles": "3"}, "<|image:0|>", 255), ({"type": "image", "tiles": True}, "<|image:0|>", 255), ({"type": "document", "pages": -1}, "<|document:0|>", 508), ({"type": "audio", "seconds": 1e300}, "<|audio:0|>", 4),
     ({"type": "audio", "seconds": 2.5}, "<|audio:0|>", 66), ({"type": "image", "tiles": 10**9, "ref": 7}, "<|image:0|>", 85 + 170 * 10**9), ({"type": "text", "text": 5}, "5", None), ({"type": "text", "text": ["</s>"]}, '["<\\/s>"]', None), ({"type": "text"}, "", None), ({"type": "a b"}, "<|a_b:0|>", 0)],
)
def test_malformed_parts_have_a_result(spark, part, segment, tokens):
    row = chat.segments(spark.createDataFrame([(1, 0, "user", json.dumps([part]))], TABLE), typed=True).first()
    assert row["segment"][row["body_start"] : row["body_end"]] == segment
    assert [a["tokens"] for a in row["attachments"]] == ([] if tokens is None else [tokens])


def test_a_placeholder_that_was_said_is_read_back_as_text():
    body, _ = chat.flatten([{"type": "text", "text": "see <|image:0|> "}, {"type": "image"}, {"type": "text", "text": "\\"}])
    assert chat.read_parts(body) == [("text", "see <|image:0|> "), ("image", "0"), ("text", "\\")]


def test_typed_conversations_count_attachments(spark):
    parts = json.dumps([{"type": "text", "text": "look"}, {"type": "image", "tiles": 2}, {"type": "audio", "seconds": 4}])
    row = chat.digest(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", "[{not json"), (1, 2, "assistant", '[{"type": 1}]')], TABLE), typed=True).first()
    assert (row["n_turns"], row["n_attachments"], row["expanded_tokens"], row["loss_chars"]) == (3, 2, 425 + 104, len("[{not json") + len('[{"type": 1}]'))
