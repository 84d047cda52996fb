"""Suffix-array dedup on bytes (operator 2).

Sorting a suffix per byte would move hundreds of times the input. The suffixes
sorted here start at content-chosen anchors (windows.py), which every repeated
400-byte string shares with its copies, and only where they are needed:

1. Runs of windows under one anchor are grouped by (anchor, hull): a run whose
   hull occurs twice is repeated as a whole. Copies, however many, end here, in
   counts made before the shuffle.
2. For anchors with several hulls, one run of each hull brings its suffix (bytes
   from the anchor on) and its reversed prefix. Sampled splitters range-partition
   the suffixes by their leading ``gram`` bytes; splitters never part equal leading
   tokens, so what could match across a bucket's border is only the first and
   last group, which lie in one bucket whole.
3. A bucket streams by in sorted groups; suffixes and reversed prefixes are sorted
   by multikey quicksort, and the common prefixes of neighbours give, for every
   offset d of a window before its anchor, which windows are equal: those in one
   class of the suffix order cut at depth 400 - d and in one class of the prefix
   order cut at depth d. This is exact.

An anchor with more than ``hot`` different hulls (a passage in that many different
surroundings) does not enter a bucket, which must hold a group whole: its windows are
counted one by one by a grouped count with partial aggregation, by two independent
64-bit hashes of their bytes.

Null texts are empty; texts shorter than the window lose nothing; matches never
cross documents; repeated rows are documents of their own; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import cut, with_row_id

#: Suffixes sorted together in a task at least (whole groups), and the most hulls of a group sorted so.
TOGETHER, HOT = 8_000, 100_000


def multikey_quicksort(rows: list[bytes]) -> np.ndarray:
    """Order of byte strings: ternary partition on one 8-byte word at a time; small parts by comparison."""
    width = -(-max(map(len, rows), default=1) // 8) * 8 or 8
    words = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), ">u8").reshape(len(rows), -1).astype("u8")
    out, at = np.empty(len(rows), "i8"), 0
    stack = [(np.arange(len(rows)), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) <= 48 or depth == words.shape[1]:
            part = sorted(part.tolist(), key=rows.__getitem__) if depth < words.shape[1] else part
            out[at : at + len(part)] = part
            at += len(part)
            continue
        w = words[part, depth]
        pivot = w[len(w) // 2]
        less, same = w < pivot, w == pivot
        stack += [(part[~(less | same)], depth), (part[same], depth + 1), (part[less], depth)]
        stack = [x for x in stack if len(x[0])]
    return out


def common_prefixes(rows: list[bytes], order: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it in ``order`` (0 for the first)."""
    width = max(map(len, rows), default=1) or 1
    m = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in order), "u1").reshape(len(rows), width)
    differ = m[1:] != m[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    sizes = np.array([len(rows[i]) for i in order])
    return np.concatenate([[0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))])


def equal_windows(left: list[bytes], right: list[bytes], dlo: np.ndarray, dhi: np.ndarray, window: int) -> np.ndarray:
    """[member, d]: does the window d bytes before the member's anchor equal another member's.

    ``left`` holds reversed prefixes, ``right`` suffixes; d is in [dlo, dhi].
    """
    n = len(left)
    by_right, by_left = multikey_quicksort(right), multikey_quicksort(left)
    lcp_right, lcp_left = common_prefixes(right, by_right), common_prefixes(left, by_left)
    out = np.zeros((n, int(dhi.max()) + 1), bool)
    a, b = np.empty(n, "i8"), np.empty(n, "i8")
    for d in range(int(dlo.min()), int(dhi.max()) + 1):
        who = np.flatnonzero((dlo <= d) & (d <= dhi))
        if len(who) < 2:
            continue
        a[by_right] = np.cumsum(lcp_right < window - d)
        b[by_left] = np.cumsum(lcp_left < d)
        code = a[who] * (n + 2) + b[who]
        order = np.argsort(code, kind="stable")
        c = code[order]
        same = c[1:] == c[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        out[who[order[twice]], d] = True
    return out


def all_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(rid, at, lo, hi, key, hull) of every run; the text stays in its task."""

    def runs(batches):
        for b in batches:
            rid, texts = b.column(0).to_numpy(), b.column(1)
            # a slice of a batch at a time: token hashes are eight times the text
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts])
            groups = np.searchsorted(sizes, np.arange(W.BUFFER * 4, (sizes[-1] if len(sizes) else 0) + W.BUFFER * 4, W.BUFFER * 4), side="right")
            last = 0
            for g in [*groups.tolist(), len(texts)]:
                if g <= last:
                    continue
                tokens = [W.BYTE_HASH[np.frombuffer(t.as_buffer(), "u1")] if t.is_valid and len(t.as_buffer()) else np.empty(0, "u8") for t in texts[last:g]]
                for buf in W.buffers(tokens, window):
                    r = W.runs(*buf, window, gram)
                    if r is not None:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rid[r.doc + last], pa.int64()), *[pa.array((x + r.base).astype("i4")) for x in (r.anchor, r.lo, r.hi)],
                             pa.array(r.key.view("i8")), pa.array(r.hull.view("i8"))],
                            names=["rid", "at", "lo", "hi", "key", "hull"],
                        )
                last = g

    return docs.select("rid", "text").mapInArrow(runs, "rid long, at int, lo int, hi int, key long, hull long")


def suffixes(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """Fetch the bytes around wanted runs (rid, at, lo, hi): (lead, rid, at, lo, hi, before, after)."""
    per = wanted.groupBy("rid").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("runs"))

    def fetch(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for rid, t, rs in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw, rid = bytes(t.as_buffer()), rid.as_py()
                for r in rs.as_py():
                    at, lo, hi = r["at"], r["lo"], r["hi"]
                    for c, x in zip(cols, (raw[at : at + gram], rid, at, lo, hi, raw[lo:at][::-1], raw[at : hi + window]), strict=True):
                        c.append(x)
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lead", "rid", "at", "lo", "hi", "before", "after"]
            )

    return docs.select("rid", "text").join(per, "rid").mapInArrow(
        fetch, "lead binary, rid long, at int, lo int, hi int, before binary, after binary"
    )


_SPANS = "rid long, start long, end long"


def _span_batch(rid, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rid, start, end)], names=["rid", "start", "end"])


def sorted_spans(sfx: DataFrame, window: int) -> DataFrame:
    """Repeated spans among suffixes, bucket by bucket."""
    n = int(sfx.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rid, at, lo, hi = (np.array([r[i] for r in rows], "i8") for i in (1, 2, 3, 4))
        dup = equal_windows([r[5] for r in rows], [r[6] for r in rows], at - hi, at - lo, window)
        edge = np.diff(np.pad(dup, ((0, 0), (1, 1))).astype("i1"), axis=1)
        who, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)  # one past the last d of each stretch, in the same order
        return _span_batch(rid[who], at[who] - last + 1, at[who] - first + window)

    def bucket(batches):
        held: list[tuple] = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return sfx.repartitionByRange(n, "lead").sortWithinPartitions("lead").mapInArrow(bucket, _SPANS)


def counted_spans(sfx: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many hulls: windows counted one by one."""

    def each(batches):
        for b in batches:
            for _, rid, at, lo, hi, before, after in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = W.BYTE_HASH[np.frombuffer(before[::-1] + after, "u1")]
                i = np.arange(hi - lo + 1)
                wins = [W.Prefix(t).of(i, i + window).view("i8") for t in (own, W.mix(own))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), rid)), pa.array(i + lo), *map(pa.array, wins)], names=["rid", "start", "win", "win2"]
                )

    one = cut(sfx.mapInArrow(each, "rid long, start long, win long, win2 long"))
    met = one.groupBy("win", "win2").agg(F.count("*").alias("n")).where("n > 1").select("win", "win2")
    return one.join(met, ["win", "win2"]).select("rid", "start", (F.col("start") + window).alias("end"))


def repeated_spans(docs: DataFrame, window: int, gram: int, hot: int = HOT) -> DataFrame:
    """(rid, start, end): byte spans to remove, unmerged. ``docs`` has rid and text."""
    runs = cut(all_runs(docs, window, gram))
    place = F.struct("rid", "at", "lo", "hi")
    hulls = cut(runs.groupBy("key", "hull").agg(F.min(place).alias("one"), F.count("*").alias("n")).withColumn("n", F.col("n").cast("int")))
    several = hulls.groupBy("key").agg(F.count("*").alias("hulls")).where("hulls > 1")
    met = runs.join(hulls.where("n > 1").select("key", "hull"), ["key", "hull"])
    whole = met.select("rid", F.col("lo").cast("long").alias("start"), (F.col("hi") + window).cast("long").alias("end"))
    wanted = hulls.join(several, "key").select("one.*", "hulls")
    sfx = suffixes(docs, wanted.where(F.col("hulls") <= hot), window, gram)
    spans = whole.unionByName(sorted_spans(sfx, window))
    if (several.agg(F.max("hulls")).first()[0] or 0) > hot:
        spans = spans.unionByName(counted_spans(suffixes(docs, wanted.where(F.col("hulls") > hot), window, gram), window))
    return spans


def remove_repeats(docs: DataFrame, window: int = 400, gram: int = 64, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary)."""
    own = with_row_id(docs.select("doc_id", "text"))
    spans = repeated_spans(own, window, gram, hot)
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def apply(batches):
        for b in batches:
            rows = []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                raw = bytes(t.as_buffer()) if t.is_valid else b""
                if s.is_valid and raw:
                    flat = s.values.flatten()
                    gone = W.covered(len(raw), flat[0].to_numpy(), flat[1].to_numpy())
                    edges = int((np.diff(np.concatenate([[False], gone]).astype("i1")) == 1).sum())
                    rows.append((len(raw), int(gone.sum()), edges, np.frombuffer(raw, "u1")[~gone].tobytes()))
                else:
                    rows.append((len(raw), 0, 0, raw))
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return own.join(per, "rid", "left").select("doc_id", "text", "spans").mapInArrow(
        apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op2_suffixes(docs: DataFrame) -> DataFrame:
    got = remove_repeats(docs)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
i AS (SELECT doc_id, h, unnest(range(0, n_bytes - 399)) AS i FROM b WHERE n_bytes >= 400),
w AS (SELECT doc_id, i, md5_number(h[i + 1:i + 400]) AS win FROM i),
m AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w SEMI JOIN m USING (win)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM e),
r AS (SELECT doc_id, no, min(i) AS a, max(i) + 400 AS z FROM s GROUP BY 1, 2),
q AS (SELECT doc_id, sum(z - a)::bigint AS n_removed, count(*) AS n_spans, [0] || list(z ORDER BY a) AS starts, list(a ORDER BY a) AS ends FROM r GROUP BY 1),
k AS (SELECT b.doc_id, CASE WHEN q.doc_id IS NULL THEN h ELSE unhex(array_to_string(list_transform(range(1, len(starts) + 1),
  lambda j: CASE WHEN starts[j] < coalesce(ends[j], n_bytes) THEN hex(h[starts[j] + 1:coalesce(ends[j], n_bytes)]) ELSE '' END), '')) END AS kept, n_bytes, n_removed, n_spans FROM b LEFT JOIN q USING (doc_id))
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(kept) AS kept_sha256 FROM k
"""


def brute(texts: list[tuple[int, str | None]], window: int = 400) -> list[tuple[int, int, int, int, str]]:
    """The same by looking at every window, for tests."""
    raws = [(d, (t or "").encode()) for d, t in texts]
    seen = Counter(hash(r[i : i + window]) for _, r in raws for i in range(len(r) - window + 1))
    out = []
    for d, r in raws:
        at = np.array([i for i in range(len(r) - window + 1) if seen[hash(r[i : i + window])] > 1], "i8")
        gone = W.covered(len(r), at, at + window)
        edges = int((np.diff(np.concatenate([[False], gone]).astype("i1")) == 1).sum())
        kept = np.frombuffer(r, "u1")[~gone].tobytes()
        out.append((d, len(r), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out
