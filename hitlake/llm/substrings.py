"""Substring dedup on words (operator 6): count-min prefilter, then exact grouping.

First pass: each partition sketches the anchors of its windows (windows.py) in a
count-min sketch of two rows of cells; sketches merge by addition, saturated at
two, as bits. A window that starts twice has an anchor that starts twice, and
counts are never underestimated, so windows whose anchor is estimated to be
unique are unique: none is lost. Second pass: only runs with an anchor estimated
repeated become rows. Rows with equal hulls are grouped exactly: all but the
earliest are wholly repeated. The earliest of each hull, where an anchor has
several hulls, are compared window by window.

A word is removed where a window that also starts earlier (smaller doc_id, or
same document and earlier start; equal ids in row order) covers it; windows are
judged on the input. Null and short texts lose nothing; repeated rows are
documents of their own; an empty table gives no rows; extra columns are ignored.
Window identity is a 64-bit hash of the word hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import cut, with_row_id

#: Sketch cells for each expected anchor, and the bounds of a row's size (bits). The upper
#: bound holds what is broadcast to 2 * 2**29 bits = 128 MB; beyond it the sketch only filters less.
CELLS_EACH, LEAST_BITS, MOST_BITS = 4, 16, 29
_CHUNK = 20  # a row is merged in chunks of 2**20 cells
#: Groups of partitions whose cells of a chunk are added up apart, each to bitmaps of a fixed size.
SALTS = 16


def _cells(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return key >> np.uint64(64 - bits), W.mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(64 - bits)


def _anchor_runs(texts: pa.Array, window: int, gram: int):
    hashes = [W.word_hashes(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else np.empty(0, "u8") for t in texts]
    for buf in W.buffers(hashes, window):
        r = W.runs(*buf, window, gram)
        if r is not None:
            yield r


def sketch(docs: DataFrame, bits: int, window: int, gram: int) -> list[np.ndarray]:
    """Two bit rows: is the cell's count two or more.

    Merged on the executors by chunk of cells and group of partitions, as cells stream
    by: a task holds two bitmaps of a chunk, however many partitions there are.
    """
    chunk = min(bits, _CHUNK)

    def partial(batches):
        held: list[list[np.ndarray]] = [[], []]
        for b in batches:
            for r in _anchor_runs(b.column(0), window, gram):
                _, at = np.unique((r.doc.astype("u8") << np.uint64(40)) + (r.base + r.anchor).astype("u8"), return_index=True)
                for row, c in enumerate(_cells(r.key[at], bits)):
                    held[row].append(c.astype("u4"))
        for row in (0, 1):
            if not held[row]:
                continue
            cell, n = np.unique(np.concatenate(held[row]), return_counts=True)
            no = cell >> np.uint32(chunk)
            cut_at = np.flatnonzero(np.diff(no, prepend=no[0] - 1 if no[0] else np.uint32(2**32 - 1)))
            for a, z in zip(cut_at, [*cut_at[1:], len(cell)], strict=True):
                data = ((cell[a:z] & np.uint32((1 << chunk) - 1)) << np.uint32(1)) | (n[a:z] > 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int32()), pa.array([int(no[a])], pa.int32()), pa.array([data.astype("<u4").tobytes()], pa.binary())],
                    names=["row", "chunk", "data"],
                )

    def counted(batches):
        """Cells of one (row, chunk, salt) after another, to two bitmaps each: seen, and seen twice."""
        key, seen, twice = None, None, None

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(seen).tobytes()], pa.binary()), pa.array([np.packbits(twice).tobytes()], pa.binary())],
                names=["row", "chunk", "seen", "twice"],
            )

        for b in batches:
            for row, no, salt, data in zip(*(b.column(i) for i in range(4)), strict=True):
                k = (row.as_py(), no.as_py(), salt.as_py())
                if k != key:
                    if key is not None:
                        yield flush()
                    key, seen, twice = k, np.zeros(1 << chunk, bool), np.zeros(1 << chunk, bool)
                d = np.frombuffer(data.as_buffer(), "<u4")
                at = d >> 1
                twice[at] |= seen[at] | ((d & 1) > 0)
                seen[at] = True
        if key is not None:
            yield flush()

    def merge(t: pa.Table) -> pa.Table:
        """At most SALTS pairs of bitmaps of a chunk to one."""
        seen, twice = np.zeros((1 << chunk) // 8, "u1"), np.zeros((1 << chunk) // 8, "u1")
        for s, w in zip(t["seen"], t["twice"], strict=True):
            s, w = np.frombuffer(s.as_buffer(), "u1"), np.frombuffer(w.as_buffer(), "u1")
            twice |= w | (seen & s)
            seen |= s
        return pa.table({"row": t["row"][:1], "chunk": t["chunk"][:1], "data": pa.array([twice.tobytes()], pa.binary())})

    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    parts = docs.select("text").mapInArrow(partial, "row int, chunk int, data binary").select("row", "chunk", salt, "data")
    bitmaps = parts.repartition("row", "chunk", "salt").sortWithinPartitions("row", "chunk", "salt").mapInArrow(counted, "row int, chunk int, seen binary, twice binary")
    merged = bitmaps.groupBy("row", "chunk").applyInArrow(merge, "row int, chunk int, data binary")
    rows = [np.zeros((1 << bits) // 8, "u1") for _ in (0, 1)]
    for r in merged.toLocalIterator():
        at = r.chunk << chunk >> 3
        rows[r.row][at : at + len(r.data)] = np.frombuffer(r.data, "u1")
    return rows


def repeated_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs whose anchor is estimated repeated: (rid, doc_id, lo, hi, key, hull)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    anchors = max(1, chars // 6 * 2 // (window - gram + 2))
    bits = min(MOST_BITS, max(LEAST_BITS, (CELLS_EACH * anchors).bit_length()))
    held = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits, window, gram))

    def runs(batches):
        def twice(key):
            return np.logical_and.reduce(
                [(r[c >> np.uint64(3)] >> (np.uint64(7) - (c & np.uint64(7))).astype("u1")) & 1 for r, c in zip(held.value, _cells(key, bits), strict=True)]
            )

        for b in batches:
            rid, doc = b.column(0).to_numpy(), b.column(1)
            for r in _anchor_runs(b.column(2), window, gram):
                at = np.flatnonzero(twice(r.key))
                own = r.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[own], pa.int64()), doc.take(pa.array(own)), pa.array((r.lo + r.base)[at], pa.int32()), pa.array((r.hi + r.base)[at], pa.int32()),
                     pa.array(r.key[at].view("i8")), pa.array(r.hull[at].view("i8"))],
                    names=["rid", "doc_id", "lo", "hi", "key", "hull"],
                )

    return docs.select("rid", "doc_id", "text").mapInArrow(runs, "rid long, doc_id long, lo int, hi int, key long, hull long")


def run_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(win, doc_id, rid, lo): each window of the wanted runs (rid, lo, hi) with its hash."""
    per = wanted.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # a document's own runs

    def each(batches):
        for b in batches:
            for rid, doc, t, rs in zip(*b.columns, strict=True):
                flat = rs.values.flatten()
                lo, hi = flat[0].to_numpy().astype("i8"), flat[1].to_numpy().astype("i8")
                words = W.word_hashes(t.as_buffer())
                n = hi - lo + 1
                start = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                win = _window_hashes(words, start, window)
                k = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(win.view("i8")), pa.array([doc.as_py()] * k, pa.int64()), pa.array(np.full(k, rid.as_py())), pa.array(start.astype("i4"))],
                    names=["win", "doc_id", "rid", "lo"],
                )

    return docs.select("rid", "doc_id", "text").join(per, "rid").select("rid", "doc_id", "text", "runs").mapInArrow(
        each, "win long, doc_id long, rid long, lo int"
    )


def _window_hashes(words: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    out, step = np.empty(len(start), "u8"), W.BUFFER
    for at in range(0, len(words), step):
        own = (start >= at) & (start < at + step)
        if own.any():
            out[own] = W.Prefix(words[at : at + step + window]).of(start[own] - at, start[own] - at + window)
    return out


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """(rid, start, end): word spans to remove, unmerged. ``docs`` has rid, doc_id, text."""
    cand = cut(repeated_runs(docs, window, gram))
    place = F.struct("doc_id", "rid", "lo", "hi")
    hulls = cut(cand.groupBy("key", "hull").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    later = cand.join(hulls.where("n > 1").select("key", "hull", "first"), ["key", "hull"]).where(place != F.col("first"))
    whole = later.select("rid", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
    several = hulls.groupBy("key").agg(F.count("*").alias("hulls")).where("hulls > 1").select("key")
    single = cut(run_windows(docs, hulls.join(several, "key").select("first.rid", "first.lo", "first.hi"), window))
    at = F.struct("doc_id", "rid", "lo")
    met = single.groupBy("win").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("win", "first")
    part = single.join(met, "win").where(at != F.col("first")).select("rid", F.col("lo").alias("start"), (F.col("lo") + window).alias("end"))
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, text): texts without repeated windows, words joined by one space."""
    own = with_row_id(docs.select("doc_id", "text"))
    spans = repeated_spans(own, window, gram)
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def apply(batches):
        for b in batches:
            words, removed, kept = [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                w = t.as_py().encode().split() if t.is_valid else []
                if s.is_valid:
                    flat = s.values.flatten()
                    gone = W.covered(len(w), flat[0].to_numpy(), flat[1].to_numpy())
                    k = [x for x, g in zip(w, gone, strict=True) if not g]
                else:
                    k = w
                words.append(len(w)), removed.append(len(w) - len(k)), kept.append(b" ".join(k).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return own.join(per, "rid", "left").select("doc_id", "text", "spans").mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, text string"
    )


def op6_substrings(docs: DataFrame) -> DataFrame:
    got = remove_repeats(docs)
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS win FROM i),
e AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM e),
n AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM g GROUP BY 1),
k AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w SEMI JOIN n USING (doc_id)),
t AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p WHERE g.p IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(CASE WHEN n.n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t.kept, '') END) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def brute(texts: list[tuple[int, str | None]], window: int = 20) -> list[tuple[int, int, int, str]]:
    """The same by looking at every window, for tests."""
    seen: set[tuple] = set()
    out = []
    for doc_id, text in sorted(texts, key=lambda x: x[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
