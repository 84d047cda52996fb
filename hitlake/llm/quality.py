"""Quality rules with risk-controlled thresholds (operator 8).

Base rules are fixed; the method's verdict comes from cutoffs on five scores. A
cutoff is used only where a labelled holdout proves it. For each stratum and rule the
cutoffs of a grid are tested in a fixed sequence from lenient to strict: k of n
documents labelled good would be rejected, and the exact binomial tail
P(Bin(n, risk) <= k) must not exceed delta / (strata * rules). The first cutoff
that fails ends the sequence and the last one proven is used, so a sequence needs
no correction for its own length (a cutoff too strict is only reached if all before
it were falsely proven or true), and Bonferroni covers strata and rules. With
probability 1 - delta every stratum loses at most ``risk`` of its good documents to
each rule. A stratum without proof rejects nothing: with no false rejection at all
it takes log(delta / (strata * rules)) / log(1 - risk) labelled good documents, some
600 with the defaults and four strata.

Null or empty texts have zero counts and fail the base rule; a null stratum is a
stratum of its own; labels with null quality are not used; documents without
labels are judged alike. Repeated ids keep a row each.
"""

from __future__ import annotations

from collections import Counter
from math import exp, lgamma, log, log1p

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Share of each score above which a document is rejected, from lenient to strict: the order of the tests.
GRID = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02]
RULES = ["symbols", "dup_lines", "repeats", "long_words", "short"]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat = 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) < len(grams):
        seen, end = Counter(grams), 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, dup, repeat


def base_counts(docs: DataFrame) -> DataFrame:
    """Whole-text counts; the text itself does not leave the task. One pass, no shuffle."""

    def count(batches):
        for b in batches:
            rows = [counts(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]],
                names=["doc_id", "stratum", *_BASE],
            )

    return docs.select("text", "doc_id", "stratum").mapInArrow(
        count, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _BASE)
    )


def _scores(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumn(
        "scores",
        F.array(
            F.least(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0)),
            F.least(F.col("n_dup_lines") * 10 / words, F.lit(1.0)),
            F.col("n_repeat_words") / words,
            F.least(F.col("word_chars") / words / 25, F.lit(1.0)),
            F.lit(25.0) / (F.col("n_words") + 25),
        ),
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact by log terms."""
    if k >= n:
        return 1.0
    terms = (lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1))
    return min(1.0, sum(map(exp, terms)))


def strictest(rejected: list[int], n: int, risk: float, level: float) -> float | None:
    """The last cutoff of GRID proven before the first that is not; ``rejected`` good documents of n by each cutoff."""
    best = None
    for g, k in zip(GRID, rejected, strict=True):
        if binomial_tail(k, n, risk) > level:
            break
        best = g
    return best


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """(stratum, cuts): the strictest proven cutoff of each rule, null where none is proven.

    The holdout is reduced to counts per stratum, rule and grid cutoff before
    anything leaves the tasks.
    """
    good = pick(labels, "doc_id", "quality").where("quality = 1").select("doc_id").distinct()
    held = scored.where(~F.col("base_failed")).join(good, "doc_id")
    hits = held.select(
        "stratum",
        F.posexplode("scores").alias("rule", "score"),
    ).groupBy("stratum", "rule").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("score") > g).alias(f"k{i}") for i, g in enumerate(GRID)]
    )
    tests = hits.select(F.count_distinct("stratum").alias("s"), F.max(F.col("stratum").isNull().cast("int")).alias("z"))
    tests = tests.select((F.coalesce(F.col("s") + F.col("z"), F.lit(1)) * len(RULES)).alias("tests"))

    def prove(frames):
        for f in frames:
            best = [strictest([int(getattr(r, f"k{i}")) for i in range(len(GRID))], int(r.n), risk, delta / r.tests) for r in f.itertuples()]
            yield pd.DataFrame({"stratum": f.stratum, "rule": f.rule, "cut": best})

    proven = hits.join(F.broadcast(tests)).mapInPandas(prove, "stratum string, rule int, cut double")  # tests: one row
    return proven.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, delta: float = 0.05
) -> DataFrame:
    """Base counts, base verdict and kept for every document.

    ``risk`` is the allowed false rejection per rule and stratum; five rules make
    at most 5 * risk. Strata are few (languages): their cutoffs are one row each.
    """
    own = docs.select(F.col("doc_id"), F.col("text"), F.col(f"`{stratum}`").cast("string").alias("stratum"))
    base = base_counts(own).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    from .common import cut

    scored = _scores(cut(base))
    cuts = cutoffs(scored, labels, risk, delta).withColumnRenamed("stratum", "s")
    joined = scored.join(cuts, F.col("stratum").eqNullSafe(F.col("s")), "left").drop("s")
    broken = F.exists(
        F.transform(F.col("scores"), lambda x, i: x > F.element_at(F.col("cuts"), i)), lambda y: F.coalesce(y, F.lit(False))
    )
    return joined.select(
        "doc_id", *_BASE, "base_failed", (~F.col("base_failed") & ~F.coalesce(broken, F.lit(False))).alias("kept")
    )


def op8_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, labels)


_SCORES = [
    "least(n_symbols / greatest(word_chars, 1), 1.0)", "least(n_dup_lines * 10 / greatest(n_words, 1), 1.0)", "n_repeat_words / greatest(n_words, 1)",
    "least(word_chars / greatest(n_words, 1) / 25, 1.0)", "25.0 / (n_words + 25)",
]
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY 1),
b AS (SELECT w.doc_id, stratum, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{', '.join(_SCORES)}] AS scores FROM b),
h AS (SELECT stratum, unnest(range(1, 6)) AS rule, unnest(scores) AS score FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (score > cut) AS k FROM h, (SELECT unnest({GRID}) AS cut) GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS tail FROM k),
q AS (SELECT *, bool_and(tail <= 0.05 / (5 * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM h)))) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS proven FROM p),
u AS (SELECT stratum, rule, min(cut) AS cut FROM q WHERE proven GROUP BY 1, 2),
x AS (SELECT s.doc_id, bool_or(s.scores[u.rule] > u.cut) AS broken FROM s JOIN u ON u.stratum IS NOT DISTINCT FROM s.stratum GROUP BY 1)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(broken, false) AS kept FROM s LEFT JOIN x USING (doc_id)
"""
