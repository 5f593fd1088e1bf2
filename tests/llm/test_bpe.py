import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from corpuslens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Codec(bpe.load_ranks(f.read()), P.PATTERN)


def texts():
    rng = random.Random(7)
    out = ["", " ", "\n\n  \t", "a", "hello world's  end\n", "<|endoftext|>", "naïve Füße 東京 🙂🙂", "x" * 5000, " " * 3000, "ab" * 400 + "é" * 300]
    out += ["".join(rng.choice("abcdetheing éß.,'\n 0123東🙂") for _ in range(rng.randrange(400))) for _ in range(200)]
    out += ["".join(map(chr, (rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD7FF)]) for _ in range(300)))) for _ in range(20)]
    return out


def test_ids_are_those_of_the_library(own, peer):
    for text, ids in zip(texts(), own.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == peer.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_heap_and_matrix_agree(own):
    pieces = [w.encode() for t in texts() for w in own.pattern.findall(t) if len(w) < 60]
    assert [np.array(own._long(p), "<u4").tobytes() for p in pieces if p not in own.ranks] == [x for p, x in zip(pieces, own.encode_pieces(pieces), strict=True) if p not in own.ranks]


def test_forgetting_changes_nothing(own, peer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for t, ids in zip(texts(), own.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == peer.encode_ordinary(t)


def test_rows_nulls_and_other_columns(spark, peer):
    rows = [(1, None, "q"), (2, "", None), (3, "to be or not", "z"), (3, "to be or not", "z"), (None, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.decoded)) for r in bpe.encode(df, PATH, P.PATTERN).collect())
    want = []
    for i, t, _ in rows:
        ids = peer.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()))
    assert got == sorted(want)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
