import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from telltale.llm import bpe, token_counts, tokens

PIECES = [
    *["a", "aa", " ", "  ", "\n", "\t", "é", "漢字", "🙂", "'s", "'ll", "123", "½", "²", "!!", "...", "\x1c", "\x85", "\xa0", "ÿ"],
    *["Ⅷ", "́", "the", " the", "_", "<|endoftext|>", "<|endof", "\x00", " ", "　", "tion", "zqx"],
]


@pytest.fixture(scope="module")
def strings(texts):
    rng = random.Random(3)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    return [*list(texts.values())[:60], *made, "a" * 2_000, "ab" * 900, " " * 700, "\n" * 99, ""]


def reference(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.PieceEncoder(bpe.read_ranks(P.path(tokens.ENCODE_RANKS)), P.PATTERN)


def test_ids_equal_the_library(encoder, strings):
    other = reference(tokens.ENCODE_RANKS)
    assert [s for s in strings if encoder.encode(s) != other.encode_ordinary(s)] == []


def test_few_states(encoder, strings, monkeypatch):
    """Starting over does not change the ids."""
    monkeypatch.setattr(bpe, "MEMO_STATES", 50)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 20)
    small = bpe.PieceEncoder(encoder.machine.ranks, P.PATTERN)
    assert all(small.encode(s) == encoder.encode(s) for s in strings[:500])


def test_round_trip(encoder, strings):
    decoder = bpe.Utf8Decoder(encoder.machine.token_of)
    assert all(decoder.decode(encoder.encode(s)) == s for s in strings)


def test_decoder_replaces_like_the_standard_library(encoder):
    rng = random.Random(4)
    decoder = bpe.Utf8Decoder(encoder.machine.token_of)
    single = {b: encoder.machine.ranks[bytes([b])] for b in range(256)}
    odd = [0xE2, 0x82, 0xAC, 0x41, 0xFF, 0xF0, 0x9F, 0x98, 0x80, 0xC3, 0xED, 0xA0, 0xF4, 0x90]
    for _ in range(2_000):
        raw = bytes(rng.choice(odd) for _ in range(rng.randint(0, 12)))
        ids = [single[b] for b in raw]
        assert decoder.decode(ids) == raw.decode("utf-8", "replace")
        assert decoder.decode_packed(np.array(ids, "<u4")).decode() == raw.decode("utf-8", "replace")


def test_packed_ids_of_any_tokens(encoder):
    """Whatever tokens follow each other, whole characters or not."""
    rng = random.Random(5)
    decoder, ids = bpe.Utf8Decoder(encoder.machine.token_of), sorted(encoder.machine.token_of)
    odd = [i for i in ids if not decoder._whole[i]]
    for _ in range(500):
        chosen = [rng.choice(rng.choice([ids, odd])) for _ in range(rng.randint(0, 20))]
        raw = b"".join(encoder.machine.token_of[i] for i in chosen)
        assert decoder.decode_packed(np.array(chosen, "<u4")) == raw.decode("utf-8", "replace").encode()


def test_states_are_made_when_needed_twice(encoder):
    machine = bpe.Transducer(encoder.machine.ranks)
    first = machine.encode(b" unheard-of")
    before = len(machine.states)
    assert before == 1
    for _ in range(30):
        assert machine.encode(b" unheard-of") == first
    assert len(machine.states) > before


def test_query(spark, docs, texts):
    other = reference(tokens.ENCODE_RANKS)
    for r in tokens.op6(spark, "/root/testdata/sf0.001").collect():
        ids = other.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encode_and_decode_tables(odd_docs, no_docs):
    path = P.path(tokens.ENCODE_RANKS)
    coded = tokens.encode(odd_docs, path, P.PATTERN)
    back = tokens.decode(coded, path, P.PATTERN).collect()
    want = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    assert sorted(map(repr, map(tuple, back))) == sorted(map(repr, want))
    assert tokens.round_trip(no_docs, path, P.PATTERN).collect() == []
    empty = [r for r in tokens.round_trip(odd_docs, path, P.PATTERN).collect() if r["doc_id"] in (1, 2)]
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(token_counts.COUNT_VOCABULARY))


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 15])
def test_counts_equal_the_library(strings, library, chunk, monkeypatch):
    """Special strings included, and wherever chunks end."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    counter = token_counts.CountingTokenizer(P.path(token_counts.COUNT_VOCABULARY), P.PATTERN)
    chosen = strings if chunk > 7 else [s for s in strings if len(s) < 60][:700]
    assert [s for s in chosen if counter.count(s) != len(library.encode(s, add_special_tokens=False).ids)] == []


def test_maps_are_associative(strings, monkeypatch):
    counter = token_counts.CountingTokenizer(P.path(token_counts.COUNT_VOCABULARY), P.PATTERN)
    for s in strings[60:300]:
        x, y, z = (counter.chunk_map(p) for p in (s[: len(s) // 3], s[len(s) // 3 : len(s) // 2], s[len(s) // 2 :]) )
        left, right = counter.join(counter.join(x, y), z), counter.join(x, counter.join(y, z))
        assert counter.finish(left) == counter.finish(right) == counter.count(s)


def test_count_query(spark, texts, library, odd_docs, no_docs):
    for r in token_counts.op8(spark, "/root/testdata/sf0.001").collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)
    path = P.path(token_counts.COUNT_VOCABULARY)
    rows = token_counts.count_tokens(odd_docs, path, P.PATTERN).collect()
    assert len(rows) == odd_docs.count()
    assert {(r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, 0)}
    assert token_counts.count_tokens(no_docs, path, P.PATTERN).collect() == []
