"""The corpus pipeline, stage by stage against brute force, on a small table with awkward rows."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from hitlake.llm import language_id, minhash, mixing, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def corpus() -> list[tuple]:
    r = random.Random(11)
    vocab = {k: ["".join(r.choices(abc, k=r.randint(3, 8))) for _ in range(150)] for k, abc in (("aa", "abcdefghi"), ("bb", "jklmnopqr"), ("cc", "stuvwxyza"))}
    say = lambda k, n: " ".join(r.choices(vocab[k], k=n))
    rows = [(i, say(k, r.randint(20, 200)), k) for i, k in enumerate(["aa", "bb", "cc"] * 12)]
    base = say("aa", 120)
    rows += [(50, base, "aa"), (51, base, "aa"), (52, base.upper(), "aa"), (53, base + " " + say("aa", 3), "aa"), (54, "12 34 !", "aa"), (55, "", "bb"), (56, None, "cc")]
    rows += [(None, say("aa", 60), "aa"), (None, say("bb", 60), "bb"), (None, say("cc", 60), "cc"), (70, say("aa", 60), "aa"), (70, say("bb", 60), "bb"), (80, say("cc", 60), "cc")]
    rows += [(90 + i, say("bb", 40) + f' token = "{"".join(r.choices("0123456789abcdef", k=40))}" ' + say("bb", 20), "bb") for i in range(8)]
    rows += [(110 + i, say("cc", 40) + f" see /usr/{''.join(r.choices('aeiourst', k=14))}/{''.join(r.choices('aeiourst', k=14))}/x " + say("cc", 9), "cc") for i in range(8)]
    rows += [(130, say("aa", 9000), "aa")]
    return [(i, t, lang, ["web", "books", None][k % 3], len(t or "")) for k, (i, t, lang) in enumerate(rows)]


def split(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into each stage, and what comes out last."""
    top, out = tmp_path_factory.mktemp("stages"), []
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(top / "documents.parquet"))
    docs = spark.read.parquet(str(top / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES:
        out.append(docs.collect())
        f(spark, docs, str(top)).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
    return top, out, docs.collect()


def test_language_stage(spark, stages):
    import zstandard as z

    top, rows, _ = stages
    learnt = language_id.learn(spark.read.parquet(str(top / "documents.parquet")))

    def kept(text):
        if not any(c.isalpha() for c in text or ""):
            return False
        sizes = []
        for k in sorted(learnt):
            d = z.ZstdCompressionDict(learnt[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters.from_level(3, window_log=19, write_content_size=0, write_checksum=0, write_dict_id=0)
            raw = language_id.letters(text).encode()
            sizes.append(sum(len(z.ZstdCompressor(dict_data=d, compression_params=p).compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)))
        low, next_ = sorted(sizes)[:2]
        return (next_ - low) / next_ >= 0.005

    want = sorted((tuple(r) for r in rows[0] if kept(r.text)), key=repr)
    assert sorted(map(tuple, rows[1]), key=repr) == want and len(rows[0]) - 8 < len(want) <= len(rows[0]) - 3


def test_minhash_stage(stages):
    rows = stages[1][1]
    sets = []
    for r in rows:
        w = [x.lower() for x in split(r.text)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * len(sets[a] | sets[b]):
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    groups = {}
    for k, g in enumerate(root):
        groups.setdefault(g, []).append(rows[k])
    want = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    assert sorted(map(tuple, stages[1][2]), key=repr) == sorted(map(tuple, want), key=repr)
    assert len(rows) - len(want) == 3


def test_unrelated_texts_with_bad_ids_stay(spark):
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choices("abcdef", k=5)) for _ in range(40))) for i in (None, None, None, 7, 7, 8)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    assert sorted((x.doc_id, x.text) for x in minhash.first_of_each(docs).collect() if x.doc_id) == sorted((i, t) for i, t in rows if i)
    assert minhash.first_of_each(docs).count() == 6


def test_secret_stage(stages):
    import re

    before, after = ({(r.doc_id, k): r for k, r in enumerate(sorted(x, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang)))} for x in stages[1][2:4])
    assert before.keys() == after.keys()
    for k, r in before.items():
        assert after[k].text == re.sub("[0-9a-f]{40}", "[SECRET]", r.text) and after[k].n_chars == len(after[k].text)
    assert sum("[SECRET]" in r.text for r in after.values()) == 8


def test_mixing_stage(stages):
    before, after = stages[1][3], stages[1][4]
    size, taken = {}, {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(split(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(split(r.text))
        assert r.n_chars == len(r.text)
        assert any(x.doc_id == r.doc_id and all(p in x.text for p in r.text.split("\n")) for x in before)
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), mixing.WEIGHTS, strict=True))
    open_, left, target = set(size), 1.5 * sum(size.values()), {}
    while open_:  # fill by weight; who is full stops, and the rest is shared anew
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    assert all(abs(taken[s] - target[s]) < 1 for s in size)


def test_piece_stage(spark, stages):
    import public_tokenizers

    rows, out = stages[1][4], stages[2]
    v = pieces.vocabulary(str(public_tokenizers.path("piece_bpe_32k.model")), 0.5)
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in rows)
    for k in (0, 1):
        got = sorted((r.doc_id is None, r.doc_id or 0, pieces.decode(v, np.frombuffer(r.ids, "<u4"))) for r in out if r.sample == k)
        assert got == texts
    assert all(r.decoded and r.n_pieces * 4 == len(r.ids) and r.log_inclusion <= 0 for r in out)


def test_run(spark, stages):
    key = lambda rows: sorted((repr(r.doc_id), r.sample, bytes(r.ids)) for r in rows)
    assert key(corpus_pipeline.run(spark, str(stages[0])).collect()) == key(stages[2])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
