import hashlib
import random

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from quire.llm import bpe_chunks, token_count, vocab
from quire.llm.catalog import BPE_JSON, BPE_RANKS

EDGES = [
    None, "", " ", "  ", "   ", "a", " a", "a ", "a  ", "a  b", "a   b", "a \n b", "a\n b", "a \nb", "\n\n  x", "x\n ",
    "it's we'll THEY'RE 'tis", "<|endoftext|>", "x<|endoftext|> y", "ünïcödé ß 漢字 かな 한글 🙂🙃", "\x00\x01\x1c \x1d\x1f  a",
    "a  　 b  c", "1234 5٣٤ ²³ ½", "ԙԚ՘֋ x", "😀" * 40, "z" * 3000, " " * 900 + "x", "!?" * 700,
    "the the the", "a\tb\t\tc \t d", "漢字　かな，。" * 300, "مرحبا بالعالم שלום नमस्ते สวัสดี " * 200, "🙂 emoji 🧑‍🚀 text 🫠 " * 300,
    "a\u180eb \u200b c\ufeffd \U0001e4d0\U0001e4d1 new letters \U00011f02\U00011f50 x 1\U0001e4f0 " * 40,
]


def noisy(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "Thnt", " ", "  ", "\n", "\n \n", "'s", "'", "'ll", "42", "é", "ñ", ".", "!!", "\t", "漢", " ", "re"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return EDGES + rows + [noisy(i, 200) for i in range(60)] + [noisy(7, 60_000)]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def brute_tiktoken():
    ranks = vocab.ranks_of_file(BPE_RANKS)
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_tokens_are_proven_one_by_one():
    whole = token_count.prove_whole_tokens(BPE_JSON)
    library = Tokenizer.from_file(BPE_JSON)
    assert len(whole) > 40_000
    for text in random.Random(1).sample(sorted(whole), 500):
        assert len(library.encode(text, add_special_tokens=False).ids) == 1
    assert "<|endoftext|>" not in whole


def test_counts_equal_the_library(spark, table, texts):
    library = Tokenizer.from_file(BPE_JSON)
    got = {r.doc_id: r for r in token_count.count_tokens(spark, table, BPE_JSON).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512), repr(text)[:80]


@pytest.mark.parametrize("task_chars", [1 << 23, 700])
def test_round_trip_equals_the_library(table, texts, task_chars):
    encoding = brute_tiktoken()
    encoded = bpe_chunks.encode(table, BPE_RANKS, chunk_chars=256, overlap=32, task_chars=task_chars)
    got = {r.doc_id: bytes(r.ids) for r in encoded.collect()}
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe_chunks.decode(encoded, BPE_RANKS).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4").tobytes()
        assert got[i] == ids, repr(text)[:80]
        assert decoded[i] == (text or "").encode()


def test_digests(spark, table, texts):
    encoding = brute_tiktoken()
    for r in bpe_chunks.encode_decode_digests(table, BPE_RANKS).collect():
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_most_texts_are_stitched(spark, sf):
    rows = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bpe = vocab.rank_bpe(BPE_RANKS)
    cuts = [bpe_chunks.cuts_of(bpe.split, t, bpe_chunks.CHUNK_CHARS, bpe_chunks.OVERLAP) for t in rows]
    long = [c for t, c in zip(rows, cuts) if len(t) > bpe_chunks.CHUNK_CHARS + bpe_chunks.OVERLAP]
    assert len(long) * 2 > len(rows) and all(len(c) > 2 for c in long)
    for text, own in zip(rows, cuts):
        ends = set(bpe_chunks.ends_of(bpe.split, text, 0))
        assert ends.issuperset(own)


def test_classes_of_code_points():
    import unicodedata

    classes = vocab.rank_bpe(BPE_RANKS).classes
    shown = [chr(c) for c in (0, 0x600, 0x5D0, 0x1F600, 0x3000, 0xFF0C, 0x2028, 0x661, 0xB2, 0xE01)]
    assert all(map(classes, shown))
    split = vocab.rank_bpe(BPE_RANKS).split
    for char in shown:
        joined = [len(split(p + char)) == 1 for p in vocab.PROBES]
        kind = "L" if unicodedata.category(char)[0] == "L" else "N" if unicodedata.category(char)[0] == "N" else "Z" if char.isspace() else "O"
        assert joined == [kind == k for k in "LNOZ"], hex(ord(char))


def test_stretches_of_odd_code_points_go_to_the_library(texts, monkeypatch):
    odd = {c: False for c in "🙂😀　٣नश\u200b"}
    rank, plain = vocab.rank_bpe(BPE_RANKS), vocab.json_bpe(BPE_JSON)
    counter = token_count.Counter(BPE_JSON, token_count.prove_whole_tokens(BPE_JSON))
    for bpe in (rank, plain):
        monkeypatch.setattr(bpe.classes, "known", dict(odd))
    encoding, library = brute_tiktoken(), Tokenizer.from_file(BPE_JSON)
    asked = []
    whole = rank.whole
    monkeypatch.setattr(rank, "whole", lambda text: asked.append(text) or whole(text))
    mixed = ["so 🙂 it goes on and on " * 200, "a 🙂  b\n 🙂 c", "🙂", " 🙂 ", "x🙂y z 1🙂2 w", "٣ 4 ٣ 5 नमश x"]
    for text in [*mixed, *(t or "" for t in texts[: len(EDGES)])]:
        ids = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert bpe_chunks.encode_text(rank, text, 64, 16) == ids, repr(text)[:80]
        told = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(plain.encode(text), "<u4").tolist() == told and counter.count(text) == len(told), repr(text)[:80]
    assert asked and max(map(len, asked[:200])) < 10


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.count_tokens(spark, none, BPE_JSON).count() == 0
    assert bpe_chunks.encode_decode_digests(none, BPE_RANKS).count() == 0


def test_json_special_strings_become_their_id():
    bpe = vocab.json_bpe(BPE_JSON)
    library = Tokenizer.from_file(BPE_JSON)
    for text in filter(None, EDGES):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
