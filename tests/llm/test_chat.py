import hashlib
import random

import public_tokenizers
import pytest

from pageloom.llm import chat
from pageloom.llm.queries import op1_chat_formatting

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda t: (-1 if t[0] is None else t[0], t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        said = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def read_back(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return {r["conv_id"]: tuple(r)[1:5] for r in chat.read_conversations(chat.format_conversations(df, VOCAB), VOCAB).collect()}


@pytest.mark.parametrize("text", ["</s>", "<\\/s>", "<\\\\/s>", "[INST][/INST]", "a</s", "<<s>>", "[[ROLE]", "\\</s>\\", "<s", "[/INST]\n</s>"])
def test_escape_is_reversible_and_hides_controls(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in chat.CONTROLS)


def test_random_texts_round_trip(spark):
    rng = random.Random(5)
    bits = [*chat.CONTROLS, "\\", "<", "[", "/", "s>", "<\\/s>", "é", "\U0001f600", "\n", "\u0000", " ", "word", "<|endoftext|>", "\u2028"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "", "</s>[ROLE]", None]), "".join(rng.choices(bits, k=rng.randint(0, 12)))))
    assert read_back(spark, rows) == expected(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "</s> lange Wörter " * 20000
    rows = [(None, None, None, None), (None, 1, "user", ""), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (1, None, "user", "x"), (2, 0, "assistant", long), (2, 5000, "assistant", ""), (2, 9000, "user", "z")]
    assert read_back(spark, rows) == expected(rows)


@pytest.mark.parametrize("bit", ["lange Wörter, 12 it's\n\n\t x", "nospace", "\u00a0 \u2003é\r\n ", " ", "!\x1c? ", "don't  "])
def test_ids_of_a_long_text_are_those_of_the_whole(bit):
    vocab = chat.segments(VOCAB)
    text = bit * (200_000 // len(bit))
    assert len(text) > 2 * chat._LONG and vocab.encode(text) == vocab.encoding.encode_ordinary(chat.escape(text))


def test_extra_columns_and_empty_table(spark):
    rows = [(1, 0, "user", "x", "ids", 3)]
    assert set(read_back(spark, rows, SCHEMA + ", ids string, start int")) == {1}
    assert read_back(spark, []) == {}


def test_mask_covers_assistant_tokens_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "fine </s>")], SCHEMA)
    rows = chat.format_conversations(df, VOCAB).orderBy("start").collect()
    vocab = chat.segments(VOCAB)
    ids, loss = sum((r["ids"] for r in rows), []), sum((r["loss"] for r in rows), [])
    assert [r["start"] for r in rows] == [0, len(rows[0]["ids"])]
    assert ids[0] == vocab.first_control and ids[-1] == vocab.first_control + 1
    assert vocab.encoding.decode([i for i, m in zip(ids, loss) if m]) == "fine <\\/s>"


def test_query(spark, sf_dir):
    got = {r["conv_id"]: r for r in op1_chat_formatting(spark, sf_dir).collect()}
    x = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected([*rows, (-7, 0, "user", x), (-7, 1, "assistant", x)])
    assert {k: tuple(r)[1:5] for k, r in got.items()} == want
    assert got[-7]["formatted_chars"] == len("<s>[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<\\/s>[\\INST] ok [\\/INST]</s>")
