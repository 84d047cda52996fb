"""MinHash near-dedup (operator 5).

A document's shingles fall in ``BANDS * ROWS`` bins by one permutation; each bin
keeps its smallest hash, and an empty bin borrows from a bin that its own hash
sequence picks (optimal densification). Documents with equal shingle sets are one
class and only its first document goes on, so copies make no pairs. Classes that
agree on a band share a bucket; a pair at similarity 0.8 misses all buckets with
probability (1 - 0.8**ROWS)**BANDS, about 4e-8.

Candidate edges are stars: each bucket links its members to its smallest one, so a
bucket of n gives n - 1 candidates. They are confirmed on full sets. What a star
cannot see, a link between two members that both miss the centre, is checked
afterwards without loss: in buckets that still hold several components, the
members outside the largest one are compared with all members by products of
incidence matrices, tile by tile, and no pair becomes a row.

Null texts and texts without words have no shingles and link with nothing; one
word is a set of one; repeated rows and repeated ids keep a row each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import among, components, cut, small_batches, stable, with_row_id

BANDS, ROWS = 72, 7
BINS = BANDS * ROWS
#: Members of one centre that are confirmed in one stretch of a task; a larger star is split by salt.
STAR = 400
#: Documents of a tile where an open bucket's members are compared.
TILE = 256
_TRIES = 64


def _densify_table() -> np.ndarray:
    t, b = np.meshgrid(np.arange(_TRIES, dtype="u8"), np.arange(BINS, dtype="u8"), indexing="ij")
    return (W.mix(t * np.uint64(1000003) + b + np.uint64(17)) % np.uint64(BINS)).astype("i8")


_PICK = _densify_table()
_ZERO = np.empty(0, "u8")
_LOWER = W.BYTE_HASH[np.frombuffer(bytes(range(256)).lower(), "u1")]


def shingle_set(raw: bytes, shingle: int = 2) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; shorter texts are one shingle."""
    b = np.frombuffer(raw, "u1")
    s, e = W.word_bounds(b)
    if not len(s):
        return _ZERO
    words = np.empty(len(s), "u8")
    at = 0
    while at < len(s):
        stop = max(int(np.searchsorted(e, s[at] + W.BUFFER, side="right")), at + 1)
        lo = s[at]
        words[at:stop] = W.Prefix(_LOWER[b[lo : e[stop - 1]]]).of(s[at:stop] - lo, e[at:stop] - lo)
        at = stop
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, "u8")
    for i in range(min(shingle, len(words))):
        out = W.mix(out + words[i : i + n] * np.uint64(2 * i + 3))
    return np.unique(out)


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes of the densified one-permutation sketch of a nonempty set."""
    h = W.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    bins = ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype("i8")
    least = np.full(BINS, np.iinfo("u8").max, "u8")
    np.minimum.at(least, bins, W.mix(h))
    full = least != np.iinfo("u8").max
    empty = np.flatnonzero(~full)
    for lo in (0, 16):  # most find a full bin among the first tries
        if len(empty):
            tries = _PICK[lo : lo + 16 if lo == 0 else _TRIES][:, empty]
            ok = full[tries]
            nth, got = ok.argmax(axis=0), ok.any(axis=0)
            source = tries[nth, np.arange(len(empty))]
            least[empty[got]] = least[source[got]] + np.uint64(0x9E3779B97F4A7C15)
            empty = empty[~got]
    for e in empty:  # very small sets: the nearest full bin to the right
        least[e] = least[(e + 1 + int(np.argmax(np.roll(full, -int(e) - 1)))) % BINS]
    m = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype="u8")
    for i in range(ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C55) + m[:, i]
    return W.mix(out)


def sketches(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """(rid, doc_id, n_shingles, a, b, bands): a and b fingerprint the set; bands is null without shingles."""

    def sketch(batches):
        for b in batches:
            n, fa, fb, bands = [], [], [], []
            for t in b.column(2):
                s = shingle_set(bytes(t.as_buffer()), shingle) if t.is_valid else _ZERO
                n.append(len(s))
                fa.append(int(W.mix(s).sum(dtype="u8").view("i8")) if len(s) else 0)
                fb.append(int(W.mix(s ^ np.uint64(0x1234567)).sum(dtype="u8").view("i8")) if len(s) else 0)
                bands.append(band_hashes(s).view("i8") if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "n_shingles", "a", "b", "bands"],
            )

    return docs.select("rid", "doc_id", "text").mapInArrow(
        sketch, "rid long, doc_id long, n_shingles long, a long, b long, bands array<long>"
    )


def confirm(docs: DataFrame, pairs: DataFrame, shingle: int = 2) -> DataFrame:
    """(centre, member, inter, uni) on full sets for distinct pairs (centre, member).

    A centre's text goes once to each stretch of its members, ahead of them; a
    task holds one centre's set and one member at a time.
    """
    # only stars larger than STAR are split; written first, so that their real size decides the join
    large = cut(pairs.groupBy("centre").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    member = pairs.join(large, "centre", "left").select(
        "centre", F.pmod(F.xxhash64("member"), salts).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("member").alias("rid")
    )
    centre = pairs.select("centre").distinct().join(large, "centre", "left").select(
        "centre", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.col("centre").alias("rid")
    )
    need = member.unionByName(centre)
    need = need.join(among(docs.select("rid", "text"), need), "rid")

    def compare(batches):
        at, held = None, _ZERO
        for b in batches:
            out: list[tuple] = []
            for c, s, role, rid, t in zip(*b.columns, strict=True):
                c, s = c.as_py(), s.as_py()
                own = shingle_set(bytes(t.as_buffer()), shingle)
                if role.as_py() == 0:
                    at, held = (c, s), own
                    continue
                assert at == (c, s), "a star's centre comes before its members"
                i = len(np.intersect1d(held, own, assume_unique=True))
                out.append((c, rid.as_py(), i, len(held) + len(own) - i))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["centre", "member", "inter", "uni"])

    return (
        need.select("centre", "salt", "role", "rid", "text")
        .repartition(F.col("centre"), F.col("salt"))
        .sortWithinPartitions("centre", "salt", "role")
        .mapInArrow(compare, "centre long, member long, inter long, uni long")
    )


def class_links(docs: DataFrame, classes: DataFrame, percent: int, shingle: int = 2) -> DataFrame:
    """(node, root) components of the classes' first documents. ``classes`` has rid, n_shingles, bands."""
    buckets = classes.select("rid", F.explode("bands").alias("hash"))  # the hash holds the band's number
    shared = buckets.groupBy("hash").agg(F.count("*").alias("n"), F.min("rid").alias("centre")).where("n > 1").drop("n")
    star = cut(buckets.join(shared, "hash").select(F.col("rid").alias("member"), "centre").distinct())
    own, theirs = (classes.select(F.col("rid").alias(c), F.col("n_shingles").alias(n)) for c, n in (("member", "mn"), ("centre", "cn")))
    sized = star.where("centre <> member").join(own, "member").join(theirs, "centre")
    pairs = cut(sized.where(100 * F.least("mn", "cn") >= percent * F.greatest("mn", "cn")).select("centre", "member"))
    done = confirm(docs, pairs, shingle)
    edges = done.where(100 * F.col("inter") >= percent * F.col("uni")).select(F.col("centre").alias("a"), F.col("member").alias("b"))
    roots = cut(components(edges))
    more = cut(cross_links(docs, open_buckets(star, roots), percent, shingle))
    if more.isEmpty():
        return roots
    return cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))


def open_buckets(star: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets of three or more that still hold several components: (bucket, rid, comp).

    Buckets of one centre are taken as one: bands gather mostly the same members.
    In a bucket of two, the star has confirmed the only pair.
    """
    own = star.select(F.col("centre").alias("bucket"), F.col("member").alias("rid"))
    named = own.join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.withColumn("comp", F.coalesce("root", "rid")).drop("root")
    several = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    return named.join(several.where("lo <> hi and n > 2").select("bucket"), "bucket")


def cross_links(docs: DataFrame, opened: DataFrame, percent: int, shingle: int = 2) -> DataFrame:
    """Links (a, b), spanning, between members of different components in open buckets.

    Members outside a bucket's largest component (minors) meet all members, tile
    by tile: a task holds two tiles of ``TILE`` documents and multiplies their
    incidence matrices, so no pair becomes a row.
    """
    opened = cut(opened)
    sizes = opened.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    big = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"))
    big = big.select(
        "bucket", F.col("m.comp").alias("main"),
        F.ceil((F.col("n") - F.col("m.n")) / TILE).cast("int").alias("minors"), F.ceil(F.col("m.n") / TILE).cast("int").alias("mains"),
    )
    r = opened.join(big, "bucket").withColumn("minor", F.col("comp") != F.col("main"))
    # tiles are numbered minors first; a group is (minor tile i, any tile j >= i)
    tile = F.when(F.col("minor"), F.pmod(F.xxhash64("rid"), "minors")).otherwise(F.col("minors") + F.pmod(F.xxhash64("rid"), "mains")).cast("int")
    r = r.withColumn("tile", tile)
    ahead = F.transform(F.sequence(F.col("tile"), F.col("minors") + F.col("mains") - 1), lambda j: F.struct(F.col("tile").alias("i"), j.alias("j")))
    behind = F.transform(F.sequence(F.lit(0), F.least("tile", F.col("minors") - 1)), lambda i: F.struct(i.alias("i"), F.col("tile").alias("j")))
    groups = F.when(F.col("minor"), F.array_union(ahead, behind)).otherwise(behind)
    rows = r.select("rid", "comp", "bucket", F.explode(groups).alias("g")).select("bucket", "g.i", "g.j", "rid", "comp")
    need = rows.join(among(docs.select("rid", "text"), opened), "rid")

    def solve(held: list[tuple]) -> pa.RecordBatch:
        rid, comp = (np.array([h[i] for h in held], "i8") for i in (0, 1))
        sets = [h[2] for h in held]
        n = np.array([len(x) for x in sets])
        vocab, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = np.cumsum(df > 1) - 1
        use = df[col] > 1
        row, col = row[use], shared[col[use]]
        k, inter = len(sets), np.zeros((len(sets), len(sets)))
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        df = np.bincount(col) if len(col) else np.zeros(0, "i8")
        heavy = df > 24
        light = ~heavy[col]
        lr, lc, gap = row[light], col[light], 1
        while gap < len(lr):  # rare shingles: their pairs, by distance in the sorted list
            same = lc[gap:] == lc[:-gap]
            if not same.any():
                break
            inter += np.bincount(lr[:-gap][same] * k + lr[gap:][same], minlength=k * k).reshape(k, k)
            gap += 1
        inter += inter.T
        hc, hr = (np.cumsum(heavy) - 1)[col[~light]], row[~light]
        step = max(1, (1 << 22) // k)
        for lo in range(0, int(heavy.sum()), step):  # common ones: a product of incidence matrices
            a, z = np.searchsorted(hc, [lo, lo + step])
            m = np.zeros((k, min(step, int(heavy.sum()) - lo)), "f4")
            m[hr[a:z], hc[a:z] - lo] = 1
            inter += m @ m.T
        uni = n[:, None] + n[None, :] - inter
        link = (100 * inter >= percent * uni) & (comp[:, None] != comp[None, :])
        first = np.where(link.any(axis=1), link.argmax(axis=1), -1)
        name = np.unique(comp, return_inverse=True)[1]
        label = np.arange(name.max() + 1)
        i, j = np.nonzero(link)
        while True:  # components of this group's components
            new = label.copy()
            np.minimum.at(new, name[i], label[name[j]])
            new = new[new]
            if (new == label).all():
                break
            label = new
        lead = {int(label[k]): c for k, c in reversed(list(zip(name, comp, strict=True)))}
        pairs = {(int(c), int(lead[int(label[k])])) for k, c, f in zip(name, comp, first, strict=True) if f >= 0}
        pairs = sorted(p for p in pairs if p[0] != p[1])
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def tiles(batches):
        at, held = None, []
        for b in batches:
            for bucket, i, j, rid, comp, t in zip(*b.columns, strict=True):
                key = (bucket.as_py(), i.as_py(), j.as_py())
                if key != at and held:
                    yield solve(held)
                    held = []
                at = key
                held.append((rid.as_py(), comp.as_py(), shingle_set(bytes(t.as_buffer()), shingle)))
        if held:
            yield solve(held)

    return (
        need.select("bucket", "i", "j", "rid", "comp", "text")
        .repartition(F.col("bucket"), F.col("i"), F.col("j"))
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(tiles, "a long, b long")
    )


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 2) -> DataFrame:
    """(rid, doc_id, n_shingles, root, component_id, kept) for documents (doc_id, text).

    ``root`` names a document's component by row: null ids and repeated ids of
    different texts share a component_id without being linked. It is null where
    there are no shingles.
    """
    small_batches(docs.sparkSession)
    own = with_row_id(docs.select("doc_id", "text"))
    sk = cut(sketches(own, shingle))
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    classes = cut(
        sk.where("n_shingles > 0").groupBy("n_shingles", "a", "b")
        .agg(F.min(first).alias("f"), F.min_by("bands", first).alias("bands"))
        .select("n_shingles", "a", "b", F.col("f.rid").alias("rid"), F.col("f.doc_id").alias("first_id"), "bands")
    )
    roots = class_links(own, classes, percent, shingle)
    named = classes.drop("bands").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("n_shingles", "a", "b", "root", "component_id")
    out = sk.drop("bands").join(named, ["n_shingles", "a", "b"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("rid", "doc_id", "n_shingles", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. A null id is never the smallest of a group that has others; a group of null ids alone has a null component_id and each of its rows is kept."""
    return near_duplicates(docs).drop("rid", "root")


def first_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Documents without the later members of each near-duplicate group: the smallest doc_id of a group stays (nulls last, ties by row)."""
    docs = stable(docs)
    found = cut(near_duplicates(docs, percent, shingle).select("rid", "doc_id", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    later = found.where("root is not null").groupBy("root").agg(F.min(order)["rid"].alias("first"))
    kept = found.where("root is null").select("rid").unionByName(later.select(F.col("first").alias("rid")))
    return with_row_id(docs).join(kept, "rid", "left_semi").drop("rid")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
k AS (SELECT s.doc_id, s.sh FROM s JOIN c USING (sh)),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM k a JOIN k b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON m.node = d.doc_id
"""
