import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from corpuslens.llm import pieces

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def peer():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return pieces.Model(f.read())


def texts():
    rng = random.Random(5)
    out = ["", " ", "   ", "\n\n  \t x", "a  b", " a", "a ", "<s> </s> <unk> <0x0A>", "▁x ▁▁y", "▁", "naïve Füße 東京 \U0001f642\U0001f642", "z\x00z �͸", "x" * 3000, " " * 3000, "ab" * 400 + "é" * 300]
    out += ["".join(rng.choice("abcdetheing éß.,'\n 0123東\U0001f642▁") for _ in range(rng.randrange(400))) for _ in range(300)]
    out += [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 14))) for _ in range(60)) for _ in range(50)]
    out += ["".join(map(chr, (rng.choice([rng.randrange(1, 127), rng.randrange(0xA0, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)]) for _ in range(300)))) for _ in range(30)]
    return out


def test_ids_and_texts_are_those_of_the_library(own, peer):
    for text in texts():
        ids = [i for c in own.chunks(text) for i in own.segment(c)]
        assert ids == peer.encode(text), text
        assert own.decode(ids) == peer.decode(ids)


def test_heap_and_scan_agree(own, monkeypatch):
    short = [c for t in texts() for c in own.chunks(t)]
    scanned = [own.segment(c) for c in short]
    monkeypatch.setattr(pieces, "LONG", 1)
    assert [own.segment(c) for c in short] == scanned


def test_models_that_chunks_do_not_suit_are_refused(own):
    with open(PATH, "rb") as f:
        data = f.read()
    at = data.index("▁▁▁▁".encode())
    with pytest.raises(ValueError, match="crosses"):
        pieces.Model(data[:at] + "abc▁▁▁".encode() + data[at + 12 :])
    with pytest.raises(ValueError, match="BPE"):
        pieces.Model(b"")


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def wanted(peer, rows):
    out = []
    for i, t in rows:
        ids = peer.encode(t or "")
        out.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(peer.decode(ids).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("fixed", [True, False])
def test_rows_by_blocks(spark, peer, monkeypatch, fixed, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "twice over"), (3, "twice over"), (None, "x y"), (None, None), (2**63 - 1, None)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, ids string, `a.b` int").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = pieces.encode(df, PATH, keep_ids=True, fixed=fixed)
    assert rows_of(got) == wanted(peer, rows)
    for r in got.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.n_tokens and peer.decode(ids) == r.decoded
    assert pieces.encode(df.limit(0), PATH).count() == 0
    assert rows_of(pieces.encode(df.where("text is null"), PATH)) == wanted(peer, [(i, t) for i, t in rows if t is None])


def test_small_blocks_give_the_same(own, peer):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a b", None, "c" * 50, "d", "", "e f"])], ["doc_id", "text"])
    old, pieces.BLOCK_CHARS = pieces.BLOCK_CHARS, 10

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 2

    import pyspark

    kept, pyspark.TaskContext = pyspark.TaskContext, Task
    try:
        got = [(n - (2 << 32), ids.to_pylist(), t) for n, ids, t in pieces._blocks([batch, batch.slice(0, 1)])]
    finally:
        pieces.BLOCK_CHARS, pyspark.TaskContext = old, kept
    assert got == [(0, [0, 1, 2], ["a b", "", "c" * 50]), (1, [3, 4, 5, 0], ["d", "", "e f", "a b"])]
