"""Memory of a worker that samples segmentations."""

import tracemalloc

import pyarrow as pa

from hitlake.llm import pieces


class _Docs:
    """Hands out the function that runs in the tasks."""

    def select(self, *cols):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_holds_little():
    words = [f"{'abcdefgh'[i % 8]}{i * 7919 % 999983}" for i in range(150_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    pieces._lattices.clear()
    pieces.vocabulary(pieces._model(), 0.5)
    run = pieces.sample_segmentations(_Docs())
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
        pieces._lattices.clear()
    assert rows == 2 * len(texts) and peak < 120
