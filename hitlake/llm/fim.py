"""Fill-in-middle transformation with a piece table (operator 11).

A document is a list of descriptors (buffer, start, length) over two buffers that never
change: the UTF-8 bytes of its text and the sentinels. Cutting splits descriptors, an
arrangement permutes the three parts and puts a sentinel's descriptor before each, and
hashes stream over what the descriptors show. ``restore`` makes a piece table over the
output, cuts it at the sentinels and applies the inverse permutation.

Texts are cut between units: runs of ASCII letters, and every other character alone.
Where to cut and which form to take come from sha256 of ``seed:doc_id``, so a rerun or a
lost executor gives the same rows. A text that holds a sentinel stays plain, as does
an empty one; a null text is empty, a null doc_id hashes as an empty one; repeated ids
and repeated rows keep a row each, and repeated ids are cut alike only where their texts
have equally many units. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, with_columns

#: Buffers a descriptor may point into.
TEXT, MARKS = 0, 1
#: Order of (prefix 0, middle 1, suffix 2) in each form.
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Sentinels before prefix, middle and suffix.
SENTINELS = ("<P>", "<M>", "<S>")
#: Bytes of text that a task turns into one Arrow batch, a longer document aside.
BATCH = 8 << 20

Piece = tuple[int, int, int]


def split(table: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """A piece table cut ``at`` bytes from its start; the descriptor that spans the place becomes two."""
    left: list[Piece] = []
    for i, (buffer, start, length) in enumerate(table):
        if at < length:
            head = [(buffer, start, at)] if at else []
            return left + head, [(buffer, start + at, length - at), *table[i + 1 :]]
        left.append((buffer, start, length))
        at -= length
    return left, []


def sentinel_pieces(sentinels: tuple[str, str, str]) -> tuple[bytes, list[Piece]]:
    """The sentinels' buffer and the descriptor of each."""
    raw, out, at = [s.encode() for s in sentinels], [], 0
    for r in raw:
        out.append((MARKS, at, len(r)))
        at += len(r)
    return b"".join(raw), out


def arrange(parts: list[list[Piece]], form: str, marks: list[Piece]) -> list[Piece]:
    """Prefix, middle and suffix as the form orders them, a sentinel before each."""
    return [d for i in ORDER[form] for d in (marks[i], *parts[i])]


def shown(table: list[Piece], buffers: tuple[bytes, ...]) -> Iterator[memoryview]:
    """What the descriptors show, piece by piece, without a copy."""
    views = [memoryview(b) for b in buffers]
    return (views[b][s : s + n] for b, s, n in table)


def digest(table: list[Piece], buffers: tuple[bytes, ...]) -> str:
    h = hashlib.sha256()
    for view in shown(table, buffers):
        h.update(view)
    return h.hexdigest()


def unit_starts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset of each unit, and of each character) of UTF-8 text."""
    b = np.frombuffer(raw, "u1")
    letter = ((b | 32) - np.uint8(97)) < 26  # unsigned: what lies below 'a' wraps round
    first = (b & 0xC0) != 0x80
    goes_on = np.zeros(len(b), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(first & ~goes_on), np.flatnonzero(first)


def draw(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 from sha256 of ``seed:doc_id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that text beside them cannot complete: none ends as one begins, none holds another."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels must not be empty, hold or overlap one another")
    return sentinels


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output string, output_sha256 string"
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def transform(docs: DataFrame, seed: str = "1", transformed_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Documents (doc_id, text) cut and rearranged.

    Returns doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null
    if plain), the piece table of the output, the output itself and its sha256.
    """
    buffer, marks = sentinel_pieces(checked(sentinels))
    held = [s.encode() for s in sentinels]

    def one(doc_id: int | None, raw: bytes) -> tuple:
        units, chars = unit_starts(raw)
        n, (h1, h2, h3, h4) = len(units), draw(seed, doc_id)
        whole, buffers = [(TEXT, 0, len(raw))] if raw else [], (raw, buffer)
        if not raw or h3 % 100 >= transformed_percent or any(m in raw for m in held):
            return n, "plain", None, None, whole, raw, digest(whole, buffers)
        ends = np.append(units, len(raw))
        a, b = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        head, suffix = split(whole, b)
        prefix, middle = split(head, a)
        form = "spm" if h4 % 100 < spm_percent else "psm"
        table = arrange([prefix, middle, suffix], form, marks)
        before = np.searchsorted(chars, [a, b])
        return n, form, int(before[0]), int(before[1] - before[0]), table, b"".join(shown(table, buffers)), digest(table, buffers)

    def pack(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        n, form, prefix, middle, tables, outputs, sha = zip(*rows, strict=True)
        pieces = [[{"buffer": b, "start": s, "length": k} for b, s, k in t] for t in tables]
        cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(pieces, _PIECES), pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _OUT.split(", ")])

    def batches(found):
        for batch in found:
            ids, rows, size = [], [], 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = raw.as_py() or b""
                ids.append(doc_id)
                rows.append(one(doc_id, raw))
                size += len(raw)
                if size >= BATCH:
                    yield pack(ids, rows)
                    ids, rows, size = [], [], 0
            if rows:
                yield pack(ids, rows)

    return pick(docs, "doc_id", "text").mapInArrow(batches, _OUT)


def restored(output: bytes, form: str, sentinels: list[bytes]) -> list[Piece]:
    """The piece table of the text over the output's bytes."""
    table: list[Piece] = [(TEXT, 0, len(output))] if output else []
    if form == "plain":
        return table
    order = ORDER[form]
    at = [output.index(sentinels[i]) for i in order]
    parts: list[list[Piece]] = [[], [], []]
    for i, start in reversed(list(zip(order, at, strict=True))):
        table, part = split(table, start)
        parts[i] = split(part, len(sentinels[i]))[1]  # without its sentinel
    return [d for part in parts for d in part]


def restore(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``rows`` with text and restored_sha256, rebuilt from their output and form alone; other columns are kept."""
    marks, keep = [s.encode() for s in checked(sentinels)], [c for c in rows.columns if c not in ("text", "restored_sha256")]
    rows = rows.select(*[f"`{c}`" for c in keep])
    at, form_at = keep.index("output"), keep.index("form")

    def batches(found):
        for batch in found:
            texts, sha = [], []
            for raw, form in zip(batch.column(at).cast(pa.binary()), batch.column(form_at).to_pylist(), strict=True):
                raw = raw.as_py()
                table = restored(raw, form, marks)
                texts.append(b"".join(shown(table, (raw,))))
                sha.append(digest(table, (raw,)))
            more = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*keep, "text", "restored_sha256"])

    return rows.mapInArrow(batches, with_columns(rows, "text string, restored_sha256 string"))


def op11_fim(docs: DataFrame) -> DataFrame:
    """Every document transformed and restored: digest per document."""
    return restore(transform(docs).drop("pieces")).drop("output", "text")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, [cast('0x' || substr(h, 1 + 8 * i, 8) AS bigint) FOR i IN range(4)] AS r FROM d),
k AS (SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END AS o FROM p),
s AS (SELECT *, strpos(o, '<P>') AS p1, strpos(o, '<S>') AS s1, strpos(o, '<M>') AS m1 FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN concat(substr(o, 4, s1 - 4), substr(o, m1 + 3), substr(o, s1 + 3, m1 - s1 - 3))
    ELSE concat(substr(o, p1 + 3, m1 - p1 - 3), substr(o, m1 + 3), substr(o, 4, p1 - 4)) END) AS restored_sha256 FROM s
"""
