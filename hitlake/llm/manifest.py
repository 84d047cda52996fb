"""Merkle manifest of a dataset by incremental witnesses (operator 13).

A tree has a leaf per row, in order; every two consecutive nodes become their hash, a
lone last one becomes the hash of itself, until one node is left. Rows form a tree in
each group (``lang``), and the groups' roots, in order, one more tree.

Leaves are appended to a stack of open subtrees. Each open subtree carries the partial
witnesses of its leaves; when its sibling completes, the two are hashed and each side's
witnesses are extended by the other's root. A task streams over aligned blocks of
``BLOCK`` leaves, so it holds one block's witnesses; the roots of blocks are appended
like leaves, ``BLOCK`` to a block again, until a group is one node. A row's witness is
that of its leaf, then of its block, and so on up.

Null columns hash as ``-``; groups are ordered null first, then by the UTF-8 bytes of
their names; rows by doc_id, null first, then by leaf, so repeated ids each keep a leaf
and repeated rows have equal leaves. A table without rows gives none. Extra columns do
not count.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, with_columns

#: Leaves, or roots of blocks, that are appended to one stack.
BLOCK = 1024
#: Columns a leaf is made of, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Side of a witness's step: the sibling lies left, lies right, or there is none.
LEFT, RIGHT, LONE = b"\x00", b"\x01", b"\x02"


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """A row's leaf as 32 bytes, with other values for some columns."""
    return F.unhex(F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in FIELDS]), 256))


def node(*digests: bytes) -> bytes:
    """H of digests, which it takes as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


class Stack:
    """Open subtrees of a block, by height: (root, leaves below). ``paths`` are the leaves' witnesses so far."""

    def __init__(self) -> None:
        self.open: list[tuple[bytes, list[int]] | None] = []
        self.paths: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.paths.append(bytearray())
        self._put(0, digest, [len(self.paths) - 1])

    def _put(self, height: int, digest: bytes, below: list[int]) -> None:
        while True:
            if height == len(self.open):
                self.open.append(None)
            sibling = self.open[height]
            if sibling is None:
                self.open[height] = (digest, below)
                return
            self.open[height] = None
            digest, below = self._join(sibling, digest, below)
            height += 1

    def _join(self, sibling: tuple[bytes, list[int]], digest: bytes, below: list[int]) -> tuple[bytes, list[int]]:
        """Two siblings completed: each side's witnesses learn the other's root."""
        left, others = sibling
        right_step, left_step = RIGHT + digest, LEFT + left
        for i in others:
            self.paths[i] += right_step
        for i in below:
            self.paths[i] += left_step
        return node(left, digest), others + below

    def close(self, height: int | None) -> bytes:
        """The block's root: lone nodes go up until one node is left, or to ``height`` in a group of several blocks."""
        at, last = 0, None  # the last node of each level; what is open above lies left of it
        while True:
            if at < len(self.open) and self.open[at] is not None:
                sibling, self.open[at] = self.open[at], None
                if last is None:
                    last = sibling
                else:
                    last = self._join(sibling, *last)
                    at += 1
                    continue
            if last is not None:
                if at == height if height is not None else not any(self.open[at:]):
                    return last[0]
                for i in last[1]:
                    self.paths[i] += LONE
                last = (node(last[0]), last[1])
            at += 1


def witnesses(nodes: DataFrame, group: str, carry: list[str], block: int) -> DataFrame:
    """One level: nodes (group, idx, total, digest, carried columns) with path and the root of their block, written as a table.

    idx counts a group's nodes from 0, total is their number; nth is the block's.
    """
    height = block.bit_length() - 1
    names = [group, "idx", "total", *carry, "digest"]
    keyed = nodes.select(*[F.col(f"`{c}`") for c in names]).withColumn("nth", F.expr(f"idx div {block}"))
    where = [names.index(group), names.index("idx"), names.index("total"), len(names) - 1, len(names)]

    def stream(batches):
        held: list[pa.RecordBatch] = []  # rows of the open block
        now, total, stack = None, 0, Stack()

        def done() -> pa.RecordBatch:
            root = stack.close(None if total <= block else height)
            t = pa.Table.from_batches(held).combine_chunks()
            n = len(t)
            cols = [*(t.column(i) for i in range(len(names))), pa.array([now[1]] * n, pa.int64()), pa.array(map(bytes, stack.paths), pa.binary()), pa.array([root] * n, pa.binary())]
            return pa.Table.from_arrays(cols, names=[*names, "nth", "path", "root"]).combine_chunks().to_batches()[0]

        for b in batches:
            g, _, totals, digests, nth = (b.column(i).to_pylist() for i in where)
            at = 0
            for i, key in enumerate(zip(g, nth, strict=True)):
                if key != now:
                    if i > at:
                        held.append(b.slice(at, i - at))
                    if held:
                        yield done()
                    held, now, total, stack, at = [], key, totals[i], Stack(), i
                stack.append(digests[i])
            if at < len(g):
                held.append(b.slice(at))
        if held:
            yield done()

    schema = with_columns(keyed.drop("nth"), "nth long, path binary, root binary")
    sent = keyed.repartition(*[F.col(f"`{c}`") for c in (group, "nth")]).sortWithinPartitions(group, "nth", "idx")
    return cut(sent.mapInArrow(stream, schema))


def numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` (a written table) with idx, a node's place in its group, and total, the group's nodes.

    Nodes are range partitioned and sorted by group and order, counted inside each range, and
    the ranges before are added; a group of any size spreads over many tasks.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = nodes.columns
    at = cols.index(group)

    def count(batches):
        part, now, local = TaskContext.get().partitionId(), (), 0
        for b in batches:
            nth = []
            for g in b.column(at).to_pylist():
                if (g,) != now:
                    now, local = (g,), 0
                nth.append(local)
                local += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=[*cols, "part", "local"])

    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (group, *order)]
    ranged = cut(nodes.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(count, with_columns(nodes, "part int, local long")))
    by = ranged.groupBy("part", group).agg(F.count("*").alias("n"))  # a row per range and group in it
    w = Window.partitionBy(group)
    by = by.select(F.col("part").alias("_part"), F.col(group).alias("_group"), F.sum("n").over(w).alias("total"), (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("before"))
    j = ranged.join(by, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return j.select(*cols, (F.col("local") + F.col("before")).alias("idx"), "total")


def tree(nodes: DataFrame, group: str, order: list[str], carry: list[str], block: int = BLOCK) -> DataFrame:
    """Nodes (group, digest, carried columns) with path, their whole witness in the group's tree, and root.

    The number of levels is the logarithm of the largest group to the base ``block``.
    """
    level = witnesses(numbered(nodes, group, order), group, carry, block)
    levels, most = [level], level.agg(F.max("total")).first()[0] or 0
    while most > block:
        most = -(-most // block)
        up = level.where(f"idx % {block} = 0").select(group, F.col("nth").alias("idx"), F.expr(f"(total + {block - 1}) div {block}").alias("total"), F.col("root").alias("digest"))
        level = witnesses(up, group, [], block)
        levels.append(level)
    above = None
    for level in reversed(levels):  # the small levels meet first: the leaves are joined once
        if above is not None:
            up = above.select(F.col(group).alias("_group"), F.col("idx").alias("_nth"), F.col("path").alias("_path"), F.col("root").alias("_root"))
            level = level.join(up, F.col(group).eqNullSafe(F.col("_group")) & (F.col("nth") == F.col("_nth")))
            level = level.withColumn("path", F.concat("path", "_path")).withColumn("root", F.col("_root")).drop("_group", "_nth", "_path", "_root")
        above = level
    return above


def steps(path: bytes) -> list[tuple[int, bytes]]:
    """A witness's steps upwards: (side, sibling's digest, empty where there is none)."""
    out, at = [], 0
    while at < len(path):
        side = path[at]
        n = 0 if side == LONE[0] else 32
        out.append((side, path[at + 1 : at + 1 + n]))
        at += 1 + n
    return out


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for side, sibling in steps(path):
        digest = node(sibling, digest) if side == LEFT[0] else node(digest, sibling) if sibling else node(digest)
    return digest


def proofs(rows: DataFrame, other: str) -> DataFrame:
    """``rows`` (digest, path, and a column ``other`` with another leaf or null) with proof_sha256 and folded_root, of ``other`` where there is one."""
    names = rows.columns
    digest, path, instead = (names.index(c) for c in ("digest", "path", other))

    def run(batches):
        for b in batches:
            sha, folded = [], []
            for d, p, o in zip(b.column(digest).to_pylist(), b.column(path).to_pylist(), b.column(instead).to_pylist(), strict=True):
                sha.append(sha256("".join(s.hex() for _, s in steps(p)).encode()).hexdigest())
                folded.append(fold(d if o is None else o, p))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.string()), pa.array(folded, pa.binary())], names=[*names, "proof_sha256", "folded_root"])

    return rows.mapInArrow(run, with_columns(rows, "proof_sha256 string, folded_root binary"))


def manifest(docs: DataFrame, tampered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Every row's leaf, its group's subroot, the root and its witness (path: steps of side and digest); digests are bytes.

    ``tampered`` may give another n_chars for rows to be checked with: their leaf is then
    in ``instead``, null elsewhere.
    """
    d = pick(docs, *FIELDS)
    other = F.lit(None).cast("binary") if tampered is None else F.when(~tampered.eqNullSafe(F.col("n_chars")), leaf(n_chars=tampered))
    leaves = cut(d.select("doc_id", "lang", leaf().alias("digest"), other.alias("instead"), F.monotonically_increasing_id().alias("salt")))
    rows = tree(leaves, "lang", ["doc_id", "digest", "salt"], ["doc_id", "instead"], block)
    tops = cut(rows.where("idx = 0").select(F.lit(0).alias("top"), "lang", F.col("root").alias("digest")))
    top = tree(tops, "top", ["lang"], ["lang"], block).select(F.col("lang").alias("_lang"), F.col("path").alias("_path"), F.col("root").alias("_root"))
    j = rows.join(top, F.col("lang").eqNullSafe(F.col("_lang")))
    return j.select("doc_id", "lang", "idx", "digest", "instead", F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("path", "_path").alias("path"))


def tampering() -> Column:
    """n_chars, one more where 7 divides the crc32 of the decimal doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(zlib.crc32(b""))) % 7 == 0
    return F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of all documents, each checked against the root after some were tampered with."""
    m = proofs(manifest(docs, tampering()), "instead")
    text = lambda c: F.lower(F.hex(c))
    return m.select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof_sha256", text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _oracle(levels: int = 40, tops: int = 12) -> str:
    """SQL for up to 2^levels rows a language and 2^tops languages: level by level, each row folded beside the tree."""
    f = lambda c: f"coalesce(strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '-')"
    made = lambda n: "sha256(concat(" + ", ".join(f(n if c == "n_chars" else c) for c in FIELDS) + "))"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], [cast(ascii(s) AS bigint) FOR s IN string_split(cast(doc_id AS varchar), '')]), lambda c, b: {step}), 4294967295)"
    out = [f"d AS (SELECT *, CASE WHEN doc_id IS NULL OR {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed FROM documents)"]
    out.append(f"l AS (SELECT doc_id, coalesce('+' || lang, '-') AS lang, {made('n_chars')} AS leaf, {made('changed')} AS other FROM d)")
    out.append("f0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, other AS fold, '' AS proof FROM l)")
    out.append("n0 AS (SELECT lang, i, leaf AS h FROM f0)")

    def up(k: int, n: str, rows: str, group: str) -> None:
        many = f"(SELECT {group}, count(*) AS c FROM {n}{k} GROUP BY 1)"
        out.append(
            f"{rows}{k + 1} AS (SELECT a.* REPLACE (CASE WHEN m.c = 1 THEN a.fold WHEN s.h IS NULL THEN sha256(a.fold) WHEN a.i % 2 = 0 THEN sha256(a.fold || s.h) ELSE sha256(s.h || a.fold) END AS fold, "
            f"CASE WHEN m.c > 1 THEN a.proof || coalesce(s.h, '') ELSE a.proof END AS proof, a.i // 2 AS i) FROM {rows}{k} a JOIN {many} m USING ({group}) "
            f"LEFT JOIN {n}{k} s ON s.{group} = a.{group} AND s.i = xor(a.i, 1))"
        )
        out.append(f"{n}{k + 1} AS (SELECT {group}, x.i // 2 AS i, CASE WHEN any_value(m.c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY x.i)) END AS h FROM {n}{k} x JOIN {many} m USING ({group}) GROUP BY {group}, x.i // 2)")

    for k in range(levels):
        up(k, "n", "f", "lang")
    out.append(f"t0 AS (SELECT 0 AS top, lang, h, row_number() OVER (ORDER BY lang = '-' DESC, encode(lang)) - 1 AS i FROM n{levels})")
    out.append(f"g0 AS (SELECT f.doc_id, f.leaf, f.fold, f.proof, t.h AS subroot, t.top, t.i FROM f{levels} f JOIN t0 t USING (lang))")
    for k in range(tops):
        up(k, "t", "g", "top")
    last = f"SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.h AS verified FROM g{tops} JOIN t{tops} t USING (top)"
    return "WITH " + ",\n".join(out) + "\n" + last


ORACLE_SQL = _oracle(24, 6)
