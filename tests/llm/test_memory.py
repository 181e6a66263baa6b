"""What a Python worker takes beside the executor's heap: bounded while it encodes, given back afterwards."""
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from ledgerlens.llm import bpe, common


def test_encoding_takes_little_beside_the_texts():
    enc = bpe.Encoder(bpe.load(public_tokenizers.path(bpe.VOCABULARY)))
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(400)) for _ in range(1000)]
    want = [enc.encode(t).tobytes() for t in texts[:3]]
    tracemalloc.start()
    got = [ids.tobytes() for k, ids in enumerate(enc.encode_many(texts)) if k < 3]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want
    assert peak < 80 << 20, peak


def test_batches_give_memory_back_at_their_end(monkeypatch):
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    assert [b.num_rows for b in common.batches([batch], 4)] == [4, 4, 2] and called == [1]


def test_give_back_runs_on_any_system():
    common.give_back()
