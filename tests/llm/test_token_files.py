"""Token files: exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vectext.llm import token_files, tokenizing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("ids", [
    [], [0], [0] * 100, [1], [255, 256, 65535, 65536, 2**32 - 1], list(range(49_000)), [7] * 9, [2**31],
])
def test_planes(kind, ids):
    block = np.array(ids, dtype="<u4")
    planes = token_files.to_planes(block, kind)
    assert token_files.from_planes(planes, len(ids), kind).tolist() == ids
    assert len(planes) == (max(ids, default=0).bit_length() + (0 if kind == "bit" else 7)) // (1 if kind == "bit" else 8)


def test_unknown_planes():
    with pytest.raises(ValueError):
        token_files.to_planes(np.zeros(1, "<u4"), "nibble")


ROWS = [
    (5, "Some words here, and MORE."), (2, ""), (3, None), (None, "no id"), (None, "none either"), (9, "long words " * 3000),
    (1, "twin"), (1, "twin"), (4, "é ß 中文 \U0001f600 text's \x1c"), (8, "a <|endoftext|> b<|startoftext|><|ENDOFTEXT|> x"), (7, "one"), (6, "a  b\n\nc"),
]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("block_ids", [3, 64, 1 << 16])
def test_files(spark, tmp_path, kind, block_ids):
    tokenizer = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3).withColumn("part", F.lit("clash"))
    out = f"{tmp_path}/ids"
    token_files.write_token_files(df, out, PATH, "words", 1, planes=kind, block_ids=block_ids)
    got = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    want, start = {}, 0
    for doc_id, text in ROWS:
        tokens = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(doc_id, []).append(np.array(tokens, dtype="<u4").tobytes())
    for r in got:
        assert r["start"] == start and 4 * r["n_tokens"] == len(r["ids"])
        want[r["doc_id"]].remove(bytes(r["ids"]))
        start += r["n_tokens"]
    assert not any(want.values())
    assert spark.read.parquet(out).agg(F.max("n_ids")).first()[0] <= block_ids


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    token_files.write_token_files(none, f"{tmp_path}/ids", PATH)
    assert token_files.read_documents(spark, f"{tmp_path}/ids").count() == 0


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_words_put_together_are_the_tokenizers_ids(name, kind, monkeypatch):
    monkeypatch.setattr(tokenizing, "MAX_WORDS", 50)  # words are forgotten on the way
    e = tokenizing.TextEncoder(public_tokenizers.path(name), kind)
    rnd = random.Random(3)
    letters = "ab'slLtdmM1! .,\n\té²ªßÉİıſ&*|)(  中\x1c\xa0\r-"
    texts = ["", " ", "a ", " a", "a's 's it'll!!", "x." * 30, "<|endoftext|>", "a <|endoftext|> b", "<|StartOfText|>a", "a <b <| c"]
    texts += ["".join(rnd.choices(letters, k=rnd.randint(1, 16))) for _ in range(4000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for text in texts:
        assert e.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("kind, name", [("bytes", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json")])
def test_words_with_marks_are_not_remembered(kind, name):
    """Letters are remembered once, whatever marks stand behind them."""
    path = public_tokenizers.path(name)
    coder, plain = tokenizing.TextEncoder(path, kind), Tokenizer.from_file(path)
    text = "stone, stone. stone!? wood; wood ... 5, x1. don't, a.b.c."
    assert coder.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    remembered = set(coder.first) | set(coder.spaced)
    assert {"stone", "wood"} <= remembered and not remembered & {"stone,", "stone.", "stone!?", "wood;", "don't,", "a.b.c."}


KINDS = [("bytes", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json"), ("whole", "byte_bpe_50k.json")]


@pytest.mark.parametrize("kind, name", KINDS)
@pytest.mark.parametrize("together", [1, 40, 1 << 20])
def test_texts_cut_together_are_each_the_tokenizers_ids(kind, name, together, monkeypatch):
    """Cut or whole, empty or not, in any slices: each text's ids are those it has alone, in order."""
    monkeypatch.setattr(tokenizing, "TOGETHER", together)
    monkeypatch.setattr(tokenizing, "MADE", 7)
    monkeypatch.setattr(tokenizing, "MAX_WORDS", 30)
    rnd = random.Random(4)
    words = ["stone", "Élan", "é.", "ŵ,", "×.", "÷;", "ª.", "²:", "x1.", "don't", "a.b's", "(it)", "5%", ".", "'s", "...", "中", "<|endoftext|>"]
    texts = ["", ".", "", " ", "é", "\n", "a", ""]
    texts += [rnd.choice((" ", "\n", "\t")).join(rnd.choices(words, k=rnd.randint(0, 9))) + rnd.choice(("", " ", "  ")) for _ in range(600)]
    coder = tokenizing.TextEncoder(public_tokenizers.path(name), kind)
    want = [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode_all(iter(texts))] == want


@pytest.mark.parametrize("kind, name", KINDS[:2])
def test_a_word_is_looked_up_once_per_slice(kind, name, monkeypatch):
    """What a frequent word costs is not a step of Python for each time it occurs."""
    asked, look_up = [], tokenizing.Words.ids_of
    monkeypatch.setattr(tokenizing.Words, "ids_of", lambda self, words: asked.extend(words) or look_up(self, words))
    coder = tokenizing.TextEncoder(public_tokenizers.path(name), kind)
    text = "the stone, the wood. " * 50 + "end"
    alone = Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode_all([text] * 40)] == [alone] * 40
    assert len(asked) <= 10


def test_checksum_of_columns(spark):
    df = spark.createDataFrame([("é",), ("",)], "t string").select(F.crc32(F.col("t").cast("binary")))
    assert [r[0] for r in df.collect()] == [zlib.crc32("é".encode()), 0]
