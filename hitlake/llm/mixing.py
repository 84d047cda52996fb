"""Mixing sources to target weights (operator 1). DataFrame functions only.

Words of a source are packed, document after document, into blocks of
``block_words``. Every output shard draws multinomial source counts: each of its
slots draws a source with probability target / sum of targets. Slot j of a source
(counted over shards) shows block perm(j): a pseudorandom permutation of the
source's block numbers, another one for each pass over the source, so no block
is shown again before all have been. Slots and blocks are joined by (source,
block).

The draws decide which blocks, and so which words of which documents, lie in which
shard (``mixed_blocks``, ``mixed_texts``, ``first_shard`` of the query); what a source
gives in all is settled afterwards: slots drawn beyond its quota are dealt to
sources still short, as one last top-up shard, and the last slot is trimmed to the
word. So a source's words taken are its target rounded down, and reruns agree.

Null texts have size 0 and are never taken; null sources are one source; empty
tables give no rows; repeated rows are packed one by one; a source without words
has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, pick, stable, with_row_id

WEIGHTS = (3, 1, 2)
#: A source's documents are numbered in this many hash buckets, so no source gathers in one task.
BUCKETS = 4096
#: Cells of the unit interval; the drawn number finds its source by an equi join on the cell.
CELLS = 2048
#: Slots of a source and shard that one task works out together.
RUN = 1024
#: Rounds of the swap-or-not permutation.
ROUNDS = 14


def _uniform(*parts: Column | str) -> Column:
    """Pseudorandom number in [0, 1) of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def permuted(j: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """Swap-or-not: a keyed permutation of 0..n-1, for any n; ``inverse`` undoes it."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        swap = F.pmod(F.xxhash64(F.lit("bit"), r, F.greatest(x, partner), *key), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(rounds, j.cast("long"), step)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add target to (source, source_size): one row per source, shares by weight, capped.

    Water filling in closed form: in order of cap / weight, a source is capped
    while the level that the rest would get exceeds its own cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sources.withColumn("w", F.when(F.col("source_size") > 0, w).cast("double"))
    s = s.withColumn("most", cap * F.col("source_size")).withColumn("level", F.col("most") / F.col("w"))
    by_level = Window.orderBy(F.col("level").asc_nulls_last(), "source")
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn(
        "fill",
        (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("fill") < F.col("level"), F.struct("level", "source", "fill"))).over(whole)["fill"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(
        F.coalesce(F.least(F.col("most"), level * F.col("w")), F.col("most"))
    )
    return s.select("source", "source_size", target.alias("target"))


def pack(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, size, start): where each document's words lie in its source."""
    own = with_row_id(docs.select("doc_id", "text", "source")).select(
        "rid", "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    sized = cut(own.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(BUCKETS)).cast("int")))
    b = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = b.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")
    )
    w = Window.partitionBy("source", "bucket").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "rid", "doc_id", "source", "size", (F.col("inner") + F.col("before")).alias("start")
    )


def quotas(goal: DataFrame, block: int, seed: int) -> DataFrame:
    """Add blocks, quota (slots to fill) and trim (words cut from the last slot) to targets."""
    key = [F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null"))]
    n, short = F.col("blocks"), F.col("blocks") * block - F.col("source_size")
    q = goal.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    for e in (0, 1):
        q = q.withColumn(f"p{e}", permuted(n - 1, n, *key, F.lit(e), inverse=True) + e * n)

    def words(slots: Column) -> Column:
        return slots * block - F.when(slots > F.col("p0"), short).otherwise(0) - F.when(slots > F.col("p1"), short).otherwise(0)

    want = F.floor("target").cast("long")
    first = F.floor(want / block).cast("long")
    tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: first + i), lambda x: words(x) >= want)
    q = q.withColumn("quota", F.array_min(tries))
    return q.select("source", "source_size", "target", "blocks", "quota", (words(F.col("quota")) - want).alias("trim"))


def drawn(quota: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source, n, first): multinomial counts of each shard, and the top-up shard.

    ``first`` is the source's slots before the shard. Everything joined here has a
    row per source, or per shard and source.
    """
    spark = quota.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    q = quota.where("quota > 0").withColumn("hi", F.sum("quota").over(order) / F.sum("quota").over(total))
    q = q.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    cells = q.select(
        "source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell")
    )
    slots = spark.range(n_slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), _uniform(F.lit(seed), F.lit("draw"), F.col("id")).alias("x")
    ).withColumn("cell", F.floor(F.col("x") * CELLS))
    got = slots.join(cells, "cell").where("x >= lo and x < hi").groupBy("shard", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))
    most = quota.select(F.col("source").alias("s"), "source_size", "quota", "blocks", "trim")
    same = F.col("source").eqNullSafe(F.col("s"))
    kept = got.join(most, same).select(
        "shard", "source", "first", F.least("n", F.col("quota") - F.col("first")).alias("n"), "source_size", "quota", "blocks", "trim"
    )
    had = got.groupBy("source").agg(F.sum("n").alias("had"))
    top = most.join(had, same, "left").select(
        F.lit(-(-n_slots // shard_slots)).cast("long").alias("shard"), F.col("s").alias("source"),
        F.coalesce("had", F.lit(0)).alias("first"), (F.col("quota") - F.coalesce("had", F.lit(0))).alias("n"), "source_size", "quota", "blocks", "trim",
    )
    return kept.unionByName(top).where("n > 0")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, block_words: int = 128, shard_slots: int = 1 << 16, seed: int = 7):
    """Plan the mix: (packed documents, targets, slots).

    slots: shard, slot (the source's own slot number), source, pass, block, filled
    (words of the block that the slot shows). ``cap`` 2 needs two passes over a
    source at most.
    """
    packed = cut(pack(docs))
    goal = cut(targets(packed.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap))
    quota = cut(quotas(goal, block_words, seed))
    n_slots = quota.agg(F.sum("quota")).first()[0] or 0
    counts = drawn(quota, n_slots, shard_slots, seed)
    # a row per shard and source is few rows: they are dealt out in runs before slots become rows
    n, last = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("first") + F.col("n") - 1
    own = ["shard", "source", "source_size", "quota", "blocks", "trim"]
    runs = counts.select(*own, last.alias("last"), F.explode(F.sequence(F.col("first"), last, F.lit(RUN).cast("long"))).alias("run")).repartition(n, "source", "run")
    slot = runs.select(*own, F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN - 1, "last"))).alias("slot"))
    key = [F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null"))]
    slot = slot.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("int"))
    slot = slot.withColumn("block", permuted(F.pmod("slot", F.col("blocks")), F.col("blocks"), *key, F.col("pass")))
    whole = F.least(F.col("source_size") - F.col("block") * block_words, F.lit(block_words))
    drop = F.when(F.col("slot") == F.col("quota") - 1, F.col("trim")).otherwise(0)
    return packed, goal, slot.select("shard", "slot", "source", "pass", "block", (whole - drop).alias("filled"))


def pieces(packed: DataFrame, block_words: int) -> DataFrame:
    """Documents cut at block borders: (rid, doc_id, source, start, block, lo, hi), words [lo, hi) of the block."""
    last = F.col("start") + F.col("size") - 1
    p = packed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor(last / block_words)))
    )
    at = F.col("block") * block_words
    return p.select(
        "rid", "doc_id", "source", "start", "block",
        F.greatest(F.col("start") - at, F.lit(0)).alias("lo"), F.least(last + 1 - at, F.lit(block_words)).alias("hi"),
    )


def placements(packed: DataFrame, slots: DataFrame, block_words: int = 128) -> DataFrame:
    """Slots joined with blocks by index: a row per shown piece of a document.

    (shard, slot, pass, rid, doc_id, source, from_word, to_word): word numbers
    inside the document. Both sides grow with the corpus and Spark knows their sizes
    only from before they were exploded, so neither may be broadcast: the hint asks
    for a merge join. A block is in one slot of a pass, and holds at most
    ``block_words`` documents, so no key is hot.
    """
    s = slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "shard", "slot", "pass", "filled")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    p = pieces(packed, block_words).join(s.hint("merge"), same).withColumn("to", F.least("hi", "filled"))
    off = F.col("block") * block_words - F.col("start")
    return p.where("to > lo").select(
        "shard", "slot", "pass", "rid", "doc_id", "source", (off + F.col("lo")).alias("from_word"), (off + F.col("to")).alias("to_word")
    )


def op1_mix(docs: DataFrame, block_words: int = 128) -> DataFrame:
    """Per document what the mix takes; ``first_shard`` is the first output shard that shows it (null: none does)."""
    packed, goal, slots = mix(docs, block_words=block_words)
    taken = placements(packed, slots, block_words).groupBy("rid").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("shard").alias("first_shard")
    )
    goal = goal.withColumnRenamed("source", "s")
    return (
        packed.join(taken.hint("merge"), "rid", "left")
        .join(goal, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
    )


def shown_text(text: Column, spans: Column) -> Column:
    """The words of sorted spans struct<from_word, to_word> as they stand in the text, with the white space between them.

    Spans that touch are one stretch; others are parted by a newline.
    """

    def stretch(words: Column, s: Column, i: Column) -> Column:
        own = F.array_join(F.slice(words, (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")), "")
        touches = (i > 0) & (F.get(spans, i - 1)["to_word"] == s["from_word"])
        first = F.regexp_replace(own, r"^[\x20\x09-\x0D]+", "")
        return F.when(touches, own).when(i > 0, F.concat(F.lit("\n"), first)).otherwise(first)

    # each word with the white space before it; the one-element array binds them: inside the lambda alone they would be cut anew for each span
    words = F.array(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})")))
    return F.transform(words, lambda w: F.array_join(F.transform(spans, lambda s, i: stretch(w, s, i)), ""))[0]


def mixed_texts(docs: DataFrame, block_words: int = 128, shard_slots: int = 1 << 16, by_shard: bool = True) -> DataFrame:
    """The mix as documents: a row per output shard, document and pass, holding the words that the shard shows of it.

    Columns of ``docs`` (doc_id, text, lang, source, n_chars) after shard; the draws
    decide which words of a document lie in which shard. Documents of which nothing
    is shown have no row; one may have several. Rows of a document grow with the
    number of shards; without ``by_shard`` it has a row per pass, two at most, with
    all that the mix takes of it in that pass, in its first shard.
    """
    docs = stable(docs)
    packed, _, slots = mix(docs, block_words=block_words, shard_slots=shard_slots)
    shown = placements(packed, slots, block_words)
    spans = F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("spans")
    if by_shard:
        shown = shown.groupBy("rid", "shard", "pass").agg(spans)
    else:
        shown = shown.groupBy("rid", "pass").agg(spans, F.min("shard").alias("shard"))
    d = with_row_id(docs).join(shown.hint("merge"), "rid")
    text = shown_text(F.col("text"), F.col("spans"))
    return d.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select("shard", *docs.columns)


def mixed_blocks(docs: DataFrame, block_words: int = 128, shard_slots: int = 1 << 16) -> DataFrame:
    """The mix as its fixed-length blocks: (shard, place, source, pass, block, doc_ids, words).

    ``place`` orders a shard's slots by hash, so sources alternate as drawn; ``words``
    has ``block_words`` words, fewer only in a source's last block and in the slot that is
    trimmed to the quota. ``doc_ids`` are the documents in it, in order.
    """
    docs = stable(docs)
    packed, _, slots = mix(docs, block_words=block_words, shard_slots=shard_slots)
    shown = placements(packed, slots, block_words).select("rid", "shard", "slot", "pass", F.struct("from_word", "to_word").alias("span"))
    per = shown.groupBy("rid").agg(F.collect_list(F.struct("shard", "slot", "pass", "span")).alias("shown"))  # a document's own pieces
    d = with_row_id(pick(docs, "doc_id", "text", "source")).join(per.hint("merge"), "rid")
    words = F.array(F.regexp_extract_all("text", F.lit(f"({WORD})")))
    cuts = F.transform(words, lambda w: F.transform("shown", lambda x: F.struct(
        x["shard"].alias("shard"), x["slot"].alias("slot"), x["pass"].alias("pass"),
        F.slice(w, (x["span"]["from_word"] + 1).cast("int"), (x["span"]["to_word"] - x["span"]["from_word"]).cast("int")).alias("words"),
    )))[0]
    own = d.select("rid", "doc_id", "source", F.inline(cuts))
    whole = own.groupBy("shard", "source", "slot", "pass").agg(F.array_sort(F.collect_list(F.struct("rid", "doc_id", "words"))).alias("parts"))
    order = F.xxhash64(F.lit("place"), "source", "slot")
    return whole.select(
        "shard", order.alias("place"), "source", "pass", "slot", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.words").alias("words")
    )
