"""Embedding near-dedup (operator 3): PCA-ordered tiled comparison.

Vectors are scaled to length 1; equal vectors of a label become one row with a
count. The principal axes come from one sum of outer products (a d x d matrix,
whatever the number of rows) and every vector is turned to them, so the first
dimensions carry most of a product. Rows are range-partitioned by label and by cells of
the two leading components, as wide as the threshold's chord is long, on sampled
splitters and packed into tiles. A tile meets tiles of the cells that its box reaches
into; a full cell's tiles are dealt out by salt. Of those, pairs go on whose boxes
over the leading components lie within the chord. Pairs of tiles are worked on by blocks of
``RUN`` tiles that follow each other: a task gets the tiles of two blocks once for all pairs
between them. In a pair of tiles, products are summed a few dimensions at a time; what
the rest can still add is bounded by the product of the suffix norms, and pairs
that cannot reach the threshold any more drop out; a tile pair without candidates
stops. Turned vectors travel in single precision; pairs within ``NEAR`` of the threshold, more
than that rounding can move a product, are decided on the vectors themselves in double precision.

Vectors of very large or very small numbers are scaled by a power of two first, which
changes no cosine. Null, zero or non-finite vectors, and rows without a label, link with nothing;
vectors link only if of equal length; repeated ids keep a row each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, with_row_id

TILE, BLOCK, BOX = 512, 8, 6
#: Tiles of a block; a task holds two.
RUN = 8
#: Rounding a unit vector to single precision moves it by 6e-8 at most, a product by 1.2e-7.
NEAR = 1e-6
#: Tiles of a cell that one task matches with their neighbours.
CELL_TILES = 256


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: (rid, vec_id, label, dim, v array<double>)."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("v", lambda x: x != 0)
    most = F.array_max(F.transform("v", F.abs))
    scale = F.when(most > 1e100, F.pow(F.lit(2.0), F.lit(-600))).when(most < 1e-100, F.pow(F.lit(2.0), F.lit(600))).otherwise(1.0)
    scaled = F.transform(F.arrays_zip(F.col("v"), F.array_repeat(scale, F.size("v")).alias("s")), lambda z: z["v"] * z["s"])
    own = F.when((most > 1e100) | (most < 1e-100), scaled).otherwise(F.col("v"))
    return vectors.withColumn("v", v).where(F.coalesce(ok, F.lit(False))).select(
        "rid", "vec_id", F.col("label").cast("string").alias("label"), F.size("v").alias("dim"), own.alias("v")
    )


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per (label, vector): its first rid, its smallest vec_id and its count."""
    return rows.groupBy("label", "dim", "v").agg(F.min("rid").alias("rep"), F.min("vec_id").alias("least_id"), F.count("*").alias("n"))


def axes(distinct: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the unit vectors of one length, as columns, strongest first."""

    def outer(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0))
            if len(m):
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim), pa.int32()), pa.array(np.tile(np.arange(dim), dim), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    parts = distinct.where(F.col("dim") == dim).select("v").mapInArrow(outer, "i int, j int, s double")
    got = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # dim * dim rows
    m = np.zeros((dim, dim))
    for r in got:
        m[r.i, r.j] = r.s
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


_TILE_SCHEMA = "tile string, label string, dim int, ids array<long>, n array<long>, turned binary, lo array<double>, hi array<double>"


def tiles(distinct: DataFrame, turn: dict[int, np.ndarray], width: float, tile: int = TILE) -> DataFrame:
    from pyspark import TaskContext

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def turned(batches):
        for b in batches:
            dims, out = b.column(1).to_numpy(), np.zeros((b.num_rows, 2))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = _matrix(b.column(2).take(pa.array(at)))
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                out[at, : min(d, 2)] = m @ turn[int(d)][:, :2]
            cell = np.floor(out / width).astype("i4")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(out[:, 0])], names=[*b.schema.names, "c1", "c2", "p1"]
            )

    def pack(batches):
        part, no, run, in_run = TaskContext.get().partitionId(), 0, 0, 0
        key, held = None, []

        def flush():
            m = np.array([h[0] for h in held])
            t = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ turn[key[1]]
            box = t[:, :BOX]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{run}-{no}"]), pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                 pa.array([[h[2] for h in held]], pa.list_(pa.int64())), pa.array([t.astype("f4").tobytes()], pa.binary()),
                 pa.array([box.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([box.max(axis=0).tolist()], pa.list_(pa.float64()))],
                names=["tile", "label", "dim", "ids", "n", "turned", "lo", "hi"],
            )

        for b in batches:
            for label, dim, v, rep, n_ in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and ((label, dim) != key or len(held) >= tile):
                    yield flush()
                    held, no, in_run = [], no + 1, in_run + 1
                    if (label, dim) != key or in_run == RUN:  # a block's tiles have one label
                        run, in_run = run + 1, 0
                key = (label, dim)
                held.append((v, rep, n_))
        if held:
            yield flush()

    rows = distinct.select("label", "dim", "v", "rep", "n").mapInArrow(
        turned, "label string, dim int, v array<double>, rep long, n long, c1 int, c2 int, p1 double"
    )
    order = ["label", "dim", "c1", "c2", "p1"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "rep").mapInArrow(pack, _TILE_SCHEMA)


def compare(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of two tiles' turned vectors whose product is above the threshold less ``NEAR``, by leading dimensions first, and which of them are within ``NEAR`` of it."""
    d, least = x.shape[1], threshold - NEAR
    total = np.zeros((len(x), len(y)))
    for lo in range(0, d, BLOCK):
        total += x[:, lo : lo + BLOCK] @ y[:, lo : lo + BLOCK].T
        rest = np.linalg.norm(x[:, lo + BLOCK :], axis=1)[:, None] * np.linalg.norm(y[:, lo + BLOCK :], axis=1)[None, :]
        i, j = np.nonzero(total + rest >= least)
        if len(i) * 8 < total.size:  # few are left: finish them one by one
            dots = np.empty(len(i))
            for k in range(0, len(i), 1 << 16):
                dots[k : k + (1 << 16)] = np.einsum("ij,ij->i", x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]])
            break
    else:
        i, j = np.nonzero(total >= least)
        dots = total[i, j]
    keep = dots >= least
    return i[keep], j[keep], dots[keep] <= threshold + NEAR


def chord(threshold: float) -> float:
    """Squared distance of unit vectors at the threshold, with room for rounding."""
    return 2 - 2 * threshold + 1e-9


def tile_pairs(tile: DataFrame, threshold: float) -> DataFrame:
    """(tile, other): tiles of one label whose boxes lie within the chord, each pair once.

    A tile stands in the cells of its box, the other in those that its box reaches; they
    meet in the lowest cell that both have. Tiles of a full cell are dealt out by salt
    and the other side goes to every salt.
    """
    reach = chord(threshold)
    width = F.lit(reach**0.5)
    cell = lambda c, i: F.floor(F.get(c, F.lit(i)) / width).cast("int")
    meta = tile.select("tile", "label", "dim", "lo", "hi", *[cell(c, i).alias(f"{c}{i}") for c in ("lo", "hi") for i in (0, 1)])
    meta = meta.na.fill(0, ["lo1", "hi1"])  # vectors of one dimension have no second axis
    grid = lambda lo, hi, i: F.explode(F.sequence(lo, hi)).alias(f"c{i}")
    own = meta.select("*", grid(F.col("lo0"), F.col("hi0"), 0)).select("*", grid(F.col("lo1"), F.col("hi1"), 1))
    far = meta.select(*[F.col(c).alias(f"o_{c}") if c not in ("label", "dim") else F.col(c) for c in meta.columns])
    far = far.select("*", grid(F.col("o_lo0") - 1, F.col("o_hi0") + 1, 0)).select("*", grid(F.col("o_lo1") - 1, F.col("o_hi1") + 1, 1))
    key = ["label", "dim", "c0", "c1"]
    full = cut(own.groupBy(*key).agg(F.ceil(F.count("*") / CELL_TILES).cast("int").alias("salts")))  # a row per label and cell
    own = own.join(full, key).withColumn("salt", F.pmod(F.xxhash64("tile"), F.col("salts")).cast("int")).drop("salts")
    far = far.join(full, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    first = (F.col("c0") == F.greatest(F.col("lo0"), F.col("o_lo0") - 1)) & (F.col("c1") == F.greatest(F.col("lo1"), F.col("o_lo1") - 1))
    gaps = F.transform(
        F.arrays_zip("lo", "hi", "o_lo", "o_hi"), lambda z: F.greatest(F.lit(0.0), z["lo"] - z["o_hi"], z["o_lo"] - z["hi"])
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    met = own.join(far, [*key, "salt"]).where((F.col("tile") <= F.col("o_tile")) & first & (apart <= reach))
    return met.select("tile", F.col("o_tile").alias("other"))


def tile_links(tile: DataFrame, threshold: float) -> DataFrame:
    """Per pair of blocks (kind, a, b): kind 0: b links counted for vector a; kind 1: a spanning edge; kind 2: a pair to decide."""
    pairs = tile_pairs(tile, threshold)
    block = lambda c: F.substring_index(c, "-", 2)  # noqa: E731  (a tile's name is partition, block, number)
    job = F.array_join(F.array_sort(F.array(block("tile"), block("other"))), "/").alias("job")
    sides = F.array(F.struct("tile", "other"), F.struct(F.col("other").alias("tile"), F.lit(None).cast("string").alias("other")))
    needed = pairs.select(job, F.inline(sides)).groupBy("job", "tile").agg(F.collect_list("other").alias("others"))  # 2 * RUN others at most
    body = needed.join(tile.select("tile", "dim", "ids", "n", "turned"), "tile")

    def link(t: pa.Table) -> pa.Table:
        r = t.to_pylist()  # 2 * RUN tiles at most
        x = {a["tile"]: np.frombuffer(a["turned"], "f4").reshape(-1, a["dim"]).astype("f8") for a in r}
        ids, n = (np.concatenate([np.array(a[c], "i8") for a in r]) for c in ("ids", "n"))
        first = dict(zip([a["tile"] for a in r], np.cumsum([0] + [len(a["ids"]) for a in r]).tolist(), strict=False))
        links, label = np.zeros(len(ids), "i8"), np.arange(len(ids))
        near_a, near_b = [], []
        for a in r:
            for other in a["others"]:
                i, j, near = compare(x[a["tile"]], x[other], threshold)
                if other == a["tile"]:
                    once = i < j
                    i, j, near = i[once], j[once], near[once]
                i, j = i + first[a["tile"]], j + first[other]
                near_a.append(ids[i[near]]), near_b.append(ids[j[near]])
                i, j = i[~near], j[~near]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                while (label[i] != label[j]).any():  # the least place of each component so far
                    low = np.minimum(label[i], label[j])
                    np.minimum.at(label, label[i], low)
                    np.minimum.at(label, label[j], low)
                    while (label[label] != label).any():
                        label = label[label]
        c, e = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        near_a, near_b = np.concatenate(near_a), np.concatenate(near_b)
        kind = np.repeat(np.arange(3), [len(c), len(e), len(near_a)]).astype("i4")
        return pa.table({"kind": kind, "a": np.concatenate([ids[c], ids[e], near_a]), "b": np.concatenate([links[c], ids[label[e]], near_b])})

    return body.groupBy("job").applyInArrow(link, "kind int, a long, b long")


def decided(pairs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n_a, n_b): of pairs (a, b) of vectors those whose cosine, in double precision, reaches the threshold."""
    own = lambda k: distinct.select(F.col("rep").alias(k), F.col("v").alias(f"v_{k}"), F.col("n").alias(f"n_{k}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    cosine = dot("v_a", "v_b") / (F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b")))
    return both.where(cosine >= threshold).select("a", "b", "n_a", "n_b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding, label)."""
    own = with_row_id(vectors.select("vec_id", "embedding", "label"))
    rows = usable(own)
    distinct = cut(distinct_vectors(rows))
    dims = [r.dim for r in distinct.select("dim").distinct().collect()]  # a few vector lengths
    found = cut(tile_links(cut(tiles(distinct, {d: axes(distinct, d) for d in dims}, chord(threshold) ** 0.5, tile)), threshold))
    more = cut(decided(found.where("kind = 2").select("a", "b"), distinct, threshold))
    both_ways = F.array(F.struct("a", F.col("n_b").alias("b")), F.struct(F.col("b").alias("a"), F.col("n_a").alias("b")))
    counts = found.where("kind = 0").select("a", "b").unionByName(more.select(F.inline(both_ways)))
    counts = counts.groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b").unionByName(more.select("a", "b"))).select(F.col("node").alias("rep"), "root")
    named = distinct.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("label", "dim", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.join(named, ["label", "dim", "v"]).select("rid", "n_links", "component_id")
    out = own.select("rid", "vec_id").join(linked, "rid", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept")
    )


def op3_embeddings(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON m.node = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
