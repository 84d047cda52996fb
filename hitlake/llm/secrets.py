"""Secret scans (operator 4). DataFrame functions only on the main path.

Candidates are the runs of 16 or more key-like characters, every one of a word, and what
is assigned to a name with a key word in it (``PASSWORD=hunter2!Xy9``, ``token = "s3cr3t"``)
when it has six or more characters, of any kind, a letter and a digit among them. Each gets
features: length, character transitions, dictionary coverage, path signs and
neighbouring words. Where a word holds several runs, a run's own part of the word is
the name right before it (``"key":"``, or the run before it and ``:``) and itself; runs
joined by dots share a name. A random forest trained from labelled findings says which
candidates are secrets; its trees are written out as one CASE expression, so the
whole scan is a projection over the text: no shuffle, no model object on the
executors.

The dictionary is the corpus' own most frequent plain words. Labelled findings may
be given as a table; by default candidates label themselves where the evidence is
plain: a key word and an assignment before a mixed run of letters and digits is a
secret; a candidate without any such neighbour that is an address, a path, all
digits or all letters is not. Every finding is learnt twice, with and without its
neighbours, so that the forest also judges by the candidate itself.

What the corpus' own findings do not show, the forest cannot know: a bare key without
a neighbouring name (as access key ids often stand) is found only if the labelled
findings hold such. A found value is replaced wherever it stands in its text.

Null texts have no candidates and stay null; empty and very long texts, repeated
rows, empty tables and extra columns are ordinary; where no findings of both kinds
exist, nothing is flagged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

GAP = r"[\x20\x09-\x0D]+"
RUN = r"[A-Za-z0-9_+/=-]{16,}"
#: What stands before a run, and the run with those that follow it after dots; possessive, so that long words need no stack.
GROUP = rf"(?s)(.*?)({RUN}+(?:\.{RUN}+)*+)"
#: The name, its sign and opening quotes at the end of what stands before a run.
NAME = r"((?:[^=:,;&?(){}\[\]|]{0,40}[=:]+)?[\"'`\[({<]*)$"
#: Names of secrets, and a value assigned to one inside a word: the value ends at quotes, brackets, blanks and what parts fields.
KEYS = r"(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|auth(?!or)|credential)"
VALUE = r"[^\x20\x09-\x0D\"'`&,;<>(){}\[\]]{6,}+"
OPEN = r"[\"'`({\[<]*+"
INSIDE = rf"(?i){KEYS}[A-Za-z0-9_-]{{0,40}}+[\"'`]?[=:]++{OPEN}({VALUE})"
#: The end of the two words before a value, where they assign to such a name.
LEFT = rf"(?i){KEYS}[A-Za-z0-9_-]{{0,40}}+[\"'`]? ?[=:]+$"
RUNS_ONLY = rf"^{RUN}+(?:\.{RUN}+)*+$"
#: Findings of each kind that are learnt from, and words in the dictionary: what the driver may hold.
FINDINGS, DICTIONARY = 3000, 300
MARK = "[SECRET]"
FEATURES = [
    "length", "digit_share", "letter_digit_changes", "case_changes", "vowel_share", "distinct_share", "coverage", "hex",
    "path_signs", "address", "quoted", "assigned", "key_word",
]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> str:
    """A pattern of the corpus' most frequent words of 3 to 8 plain letters."""
    words = docs.select(F.explode(F.split(F.lower("text"), GAP)).alias("w")).where(F.col("w").rlike("^[a-z]{3,8}$"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size).collect()
    return "|".join(sorted((r.w for r in top), key=lambda w: (-len(w), w))) or "(?!)"


def _runs(word: Column, before2: Column, before1: Column, after1: Column) -> Column:
    """The candidates of a word that holds a run."""

    def part(group: Column, k: Column, name: Column) -> Column:
        inner = F.when(k > 0, F.regexp_extract(group, "^[A-Za-z0-9_-]{1,40}=(?=[^=.])", 0)).otherwise("")
        return F.concat(name, inner)

    def of_group(zs: Column, z: Column, i: Column) -> Column:
        lead = F.concat(F.right(F.coalesce(F.get(zs, i - 1)["group"], F.lit("")), F.lit(40)), F.right(z["gap"], F.lit(80)))
        alone = (F.size(zs) == 1) & ~F.contains(z["group"], F.lit("."))
        return F.flatten(F.transform(F.array(F.regexp_extract(lead, NAME, 1)), lambda name: F.transform(
            F.split(z["group"], r"\."),
            lambda core, k: F.struct(
                core.alias("core"), F.when(alone, word).otherwise(F.concat(part(z["group"], k, name), core)).alias("word"),
                F.when((i > 0) & name.rlike("[=:]"), "").otherwise(before2).alias("before2"),
                F.when((i > 0) & name.rlike("[=:]"), "").otherwise(before1).alias("before1"), after1.alias("after1"),
            ),
        )))

    gaps, groups = (F.regexp_extract_all(word, F.lit(GROUP), F.lit(i)) for i in (1, 2))
    zipped = F.array(F.zip_with(gaps, groups, lambda a, b: F.struct(a.alias("gap"), b.alias("group"))))
    return F.flatten(F.flatten(F.transform(zipped, lambda zs: F.transform(zs, lambda z, i: of_group(zs, z, i)))))


def _assigned(word: Column, before2: Column, before1: Column, after1: Column) -> Column:
    """What a word, or the two words before it, assign to a key word's name, where it is not of runs anyhow."""
    inside = F.zip_with(
        F.regexp_extract_all(word, F.lit(INSIDE), F.lit(0)), F.regexp_extract_all(word, F.lit(INSIDE), F.lit(1)),
        lambda a, v: F.struct(F.rtrim(v, F.lit(".:")).alias("core"), a.alias("word")),
    )
    lead = F.concat_ws(" ", F.right(before2, F.lit(80)), F.right(before1, F.lit(80)))
    value = F.rtrim(F.regexp_extract(word, rf"^{OPEN}({VALUE})", 1), F.lit(".:"))
    after = F.when(before1.rlike("[=:]$") & lead.rlike(LEFT), F.array(F.struct(value.alias("core"), word.alias("word")))).otherwise(F.array())
    mixed = F.filter(
        F.concat(after, inside),
        lambda c: (F.length(c["core"]) >= 6) & c["core"].rlike("[0-9]") & c["core"].rlike("[A-Za-z]") & ~c["core"].rlike(RUNS_ONLY),
    )
    return F.transform(mixed, lambda c: F.struct(
        c["core"].alias("core"), c["word"].alias("word"), before2.alias("before2"), before1.alias("before1"), after1.alias("after1")
    ))


def _part_of(run: Column, values: Column) -> Column:
    """A run inside a value, or one that is a name, its ``=`` and the start of a value: the value stands for it."""
    tail = F.substring_index(run, "=", -1)
    named = F.contains(run, F.lit("=")) & (tail != "")
    return F.exists(values, lambda v: F.contains(v["core"], run) | (named & F.startswith(v["core"], tail)))


def candidates(text: Column) -> Column:
    """array<struct<core, word, before2, before1, after1>> of a text."""
    words = F.split(F.coalesce(text, F.lit("")), GAP)

    def found(ws: Column) -> Column:
        def of_word(w: Column, i: Column) -> Column:
            near = [F.coalesce(F.get(ws, i + k), F.lit("")) for k in (-2, -1, 1)]
            runs = F.when((F.length(w) >= 16) & w.rlike(RUN), _runs(w, *near))
            # most words end here: what is assigned has a digit, and its sign in the word or before it
            may = (F.length(w) >= 6) & w.rlike("[0-9]") & (w.rlike("[=:]") | near[1].rlike("[=:]$"))
            values = F.when(may, _assigned(w, *near))
            both = F.concat(F.filter(runs, lambda r: ~_part_of(r["core"], values)), values)
            return F.when(runs.isNotNull() & values.isNotNull(), both).otherwise(F.coalesce(runs, values))

        return F.flatten(F.filter(F.transform(ws, of_word), lambda c: c.isNotNull()))

    # a one-element transform binds the words once, so they are split once
    return F.flatten(F.transform(F.array(words), found))


def features(c: Column, words: str) -> Column:
    """Struct of doubles in FEATURES order for a candidate struct."""
    core, n = c["core"], F.length(c["core"]).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(core, F.lit(pattern)) / n

    def flag(x: Column) -> Column:
        return x.cast("int").cast("double")

    near = F.concat_ws(" ", c["before2"], c["before1"], F.regexp_extract(c["word"], r"^([^=:]{0,40})[=:]", 1))
    return F.array(
        n,
        share("[0-9]"),
        share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        share("[aeiouAEIOU]"),
        F.size(F.array_distinct(F.split(core, ""))) / n,
        1 - F.length(F.regexp_replace(F.lower(core), words, "")) / n,
        flag(core.rlike("^(0x)?[0-9a-fA-F]+$")),
        F.regexp_count(c["word"], F.lit(r"[/\\.]")).cast("double"),
        flag(c["word"].rlike("@|://")),
        flag(c["word"].rlike("[\"'`]")),
        flag(c["before1"].rlike("[=:]$") | c["word"].rlike(r"^[^=:]{1,40}[=:]")),
        flag(near.rlike("(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)")),
    )


def evident(f: Column) -> Column:
    """1.0 or 0.0 where the evidence is plain, else null."""
    secret = (f[12] == 1) & (f[11] == 1) & (f[1] > 0.1) & (f[1] < 0.95)
    other = (f[12] == 0) & (f[11] == 0) & ((f[9] == 1) | (f[8] >= 2) | (f[1] == 0) | (f[1] == 1))
    return F.when(secret, 1.0).when(other, 0.0)


def findings(docs: DataFrame, words: str, most: int = FINDINGS) -> DataFrame:
    """(features, label): a bounded sample of evident candidates, chosen by hash."""
    c = docs.select(F.explode(candidates(F.col("text"))).alias("c"))
    c = c.select("c", features(F.col("c"), words).alias("features")).withColumn("label", evident(F.col("features"))).where("label is not null")
    c = c.select("features", "label", F.xxhash64("c.core").alias("h")).distinct()
    picked = [c.where(F.col("label") == k).orderBy("h", "features").limit(most) for k in (0.0, 1.0)]
    return picked[0].unionByName(picked[1]).select("features", "label")


def _tree_sql(lines: list[str], at: int) -> tuple[str, int]:
    """One node of Spark's printed tree as SQL over f; returns the next line's number."""
    line = lines[at].strip()
    if m := re.match(r"Predict: (\S+)", line):
        return m[1], at + 1
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    yes, at = _tree_sql(lines, at + 1)
    no, at = _tree_sql(lines, at + 1)  # the Else line holds nothing new
    return f"CASE WHEN f[{m[1]}] <= {m[2]}D THEN {yes} ELSE {no} END", at


def forest(labelled: DataFrame, trees: int = 15, depth: int = 5, seed: int = 11) -> str | None:
    """Train on (features, label); the forest as SQL over an array ``f``, its share of votes. None without both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    alone = F.concat(F.slice("features", 1, 10), F.array(*[F.lit(0.0)] * 3))
    both = labelled.unionByName(labelled.select(alone.alias("features"), "label"))
    data = both.select(array_to_vector("features").alias("features"), "label").coalesce(1).cache()  # bounded by 4 * FINDINGS rows
    try:
        if data.select("label").distinct().count() < 2:
            return None
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    finally:
        data.unpersist()
    parts = []
    for block in re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", model.toDebugString)[1:]:
        parts.append(_tree_sql([x for x in block.split("\n") if x.strip()], 0)[0])
    return "(" + " + ".join(parts) + f") / {len(parts)}D"


def scan(docs: DataFrame, threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """Add n_candidates, secrets array<string>, max_score and redacted to docs (any columns, with text); columns of these names are replaced."""
    text_only = pick(docs, "text")
    words = dictionary(text_only)
    rule = forest(labelled if labelled is not None else findings(text_only, words)) or "0D"
    c = F.transform(candidates(F.col("text")), lambda c: F.struct(c["core"].alias("core"), features(c, words).alias("f")))
    found = docs.drop("n_candidates", "secrets", "max_score", "redacted")
    taken = {x.lower() for x in found.columns}
    work, marks = [x for x in (f"__{i}" for i in range(len(taken) + 2)) if x not in taken][:2]
    found = found.withColumn(work, c)
    scored = F.expr(f"transform({work}, c -> named_struct('core', c.core, 'score', element_at(transform(array(c.f), f -> {rule}), 1)))")
    found = found.withColumn(marks, scored)
    secrets = F.array_distinct(F.transform(F.filter(marks, lambda s: s["score"] > threshold), lambda s: s["core"]))
    found = found.withColumn("secrets", secrets)
    # longest first: a secret may be a part of another
    longest = F.array_sort("secrets", lambda a, b: F.length(b) - F.length(a))
    redacted = F.aggregate(longest, F.col("text"), lambda t, s: F.replace(t, s, F.lit(MARK)))
    return (
        found.withColumn("n_candidates", F.size(work).cast("long"))
        .withColumn("max_score", F.array_max(F.transform(marks, lambda s: s["score"])))
        .withColumn("redacted", redacted)
        .drop(work, marks)
    )


def op4_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"),
        F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"),
    )
