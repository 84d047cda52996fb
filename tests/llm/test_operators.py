"""Training-data operators against brute force on small frames with awkward rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlake.llm import embeddings, language_id, minhash, mixing, pieces, quality, secrets, substrings, suffixes, token_output
from hitlake.llm.common import among, components, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, spans string, label string"


def corpus() -> list[tuple]:
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    base, passage = say(200), say(90)
    texts: list[str | None] = [None, "", " ", "one", "a b", "\n\n", "é 漢字 x😀 " + say(30)]
    texts += [say(r.randint(30, 260)) for _ in range(25)]
    texts += [base, base, base + " tail", "head " + base, " ".join(w if r.random() > 0.03 else "zz" for w in base.split())]
    texts += [say(40) + " " + passage + " " + say(40) for _ in range(6)] + [passage + " " + passage, "x " * 900, say(3000)]
    return [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "c"][i % 4], 0, "r", "s", "l") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_suffixes(docs):
    want = sorted(suffixes.brute([(r[0], r[1]) for r in corpus()]), key=repr)
    assert rows(suffixes.op2_suffixes(docs)) == want
    hot = suffixes.remove_repeats(docs, hot=1)  # every anchor takes the counted way
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in hot.collect()) == sorted(want)


def test_multikey_quicksort():
    r = random.Random(1)
    xs = [bytes(r.choices(b"ab", k=r.randint(0, 40))) for _ in range(500)]
    assert [xs[i] for i in suffixes.multikey_quicksort(xs)] == sorted(xs)


def test_substrings(docs):
    assert rows(substrings.op6_substrings(docs)) == sorted(substrings.brute([(r[0], r[1]) for r in corpus()]), key=repr)


def test_minhash(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in corpus()}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if i and 100 * i >= 80 * u:
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    want = sorted((i, len(sets[i]), root[i], root[i] == i) for i in sets)
    assert sorted(map(tuple, minhash.op5_minhash(docs).collect())) == want


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (3, 1)], "a long, b long")
    assert sorted(map(tuple, components(e).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (9, 6)]


def test_among(spark):
    wanted = spark.range(0, 3000, 10).withColumnRenamed("id", "rid")
    df = spark.range(3000).withColumnRenamed("id", "rid")
    for bits, most in ((1 << 26, 700), (1 << 10, 3000)):  # a full bitmap lets more through, and loses none
        got = {r.rid for r in among(df, wanted, most_bits=bits).collect()}
        assert set(range(0, 3000, 10)) <= got and len(got) <= most
    assert among(df, wanted.where("rid < 0")).collect() == []


def test_embeddings(spark):
    ship(spark)
    g = np.random.default_rng(5)
    base = g.normal(size=(12, 8))
    v = [(base[i % 12] + g.normal(size=8) * (i % 5) * 0.12).tolist() for i in range(120)]
    data = [(i, x, i % 3) for i, x in enumerate(v)] + [(200, v[0], 0), (201, None, 0), (202, [0.0] * 8, 0), (203, [1.0, float("nan")] + [0.0] * 6, 0), (204, v[0], None), (205, [1.0], 0)]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<float>, label int, tile string").repartition(3)
    vec = {i: np.array(x, "f4").astype("f8") for i, x, lab in data if lab is not None and x is not None and len(x) == 8 and np.isfinite(x).all() and any(x)}
    label = {i: lab for i, _, lab in data}
    root, n = {d[0]: d[0] for d in data}, {d[0]: 0 for d in data}
    for a, b in itertools.combinations(sorted(vec), 2):
        if label[a] == label[b] and vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]) >= 0.93:
            n[a] += 1
            n[b] += 1
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if x == hi else x for k, x in root.items()}
    assert max(n.values()) > 2
    got = sorted(map(tuple, embeddings.near_duplicates(df, tile=16).collect()))
    assert got == sorted((i, n[i], root[i], root[i] == i) for i in root)


def test_embeddings_at_the_threshold(spark):
    ship(spark)
    gaps = [s * x for x in (0, 1e-15, 1e-9, 1e-7, 5e-7, 9e-7, 2e-6, 1e-4) for s in (1, -1)]
    v = [[1.0, 0.0, 0.0]] + [[0.93 + x, math.sqrt(1 - (0.93 + x) ** 2) * math.cos(k), math.sqrt(1 - (0.93 + x) ** 2) * math.sin(k)] for k, x in enumerate(gaps)]
    v = [[3.7 * y for y in x] if i % 3 else x for i, x in enumerate(v)]
    data = [(i, x) for i, x in enumerate(v)] + [(3, v[3]), (50, v[0]), (51, v[0]), (None, v[5]), (None, [0.0, -1.0, -1.0])]
    # products within 1e-14 of the threshold depend on the order of summing
    dot = lambda p, q: sum(a * b for a, b in zip(p, q, strict=True))
    links = [sum(i != j and dot(p, q) / (math.sqrt(dot(p, p)) * math.sqrt(dot(q, q))) >= 0.93 for j, (_, q) in enumerate(data)) for i, (_, p) in enumerate(data)]
    assert len(set(links)) > 3
    df = spark.createDataFrame([(i, x, 1) for i, x in data], "vec_id long, embedding array<double>, label int").repartition(3)
    got = embeddings.near_duplicates(df, tile=2).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.vec_id, r.n_links) for r in got), key=order) == sorted(((i, n) for (i, _), n in zip(data, links, strict=True)), key=order)


def test_embeddings_of_extreme_size(spark):
    ship(spark)
    v = [[1e200, 0.0], [1e200, 1.0], [1.0, 0.0], [1e-200, 0.0], [5e-324, 0.0], [1.7e308, 1.7e308], [1.0, 1.0], [0.0, 1e-310]]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_tile_pairs(spark):
    r = np.random.default_rng(2)
    boxes = []
    for i in range(120):
        lo = r.uniform(-1, 1, 6)
        boxes.append((f"t{i}", "ab"[i % 2], 8, lo.tolist(), (lo + r.uniform(0, 0.5, 6)).tolist()))
    boxes += [("u0", "c", 1, [0.5], [0.6]), ("u1", "c", 1, [0.7], [0.7])]
    df = spark.createDataFrame(boxes, "tile string, label string, dim int, lo array<double>, hi array<double>")
    want = set()
    for a in boxes:
        for b in boxes:
            if a[1:3] == b[1:3] and a[0] <= b[0]:
                gap = np.maximum(0, np.maximum(np.array(a[3]) - b[4], np.array(b[3]) - a[4]))
                if gap @ gap <= embeddings.chord(0.93):
                    want.add((a[0], b[0]))
    got = [tuple(x) for x in embeddings.tile_pairs(df, 0.93).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 7000


def test_mixing(docs, empty):
    got = mixing.op1_mix(docs, block_words=16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.op1_mix(docs, block_words=16).collect()), key=repr)
    src = {r[0]: r[3] for r in corpus()}
    size, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len((dict((x[0], x[1]) for x in corpus())[r.doc_id] or "").encode().split())
        assert r.taken <= 2 * r["size"]
        s = src[r.doc_id]
        size[s], taken[s], target[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r.taken, r.target
    assert len(got) == len(corpus()) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    weight = dict(zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True))
    level = max(target[s] / weight[s] for s in size)
    for s in size:
        assert target[s] == pytest.approx(min(2 * size[s], level * weight[s])) and abs(taken[s] - target[s]) < 1
    assert mixing.op1_mix(empty).collect() == []


def test_mixed_blocks(docs):
    """Blocks against a plain packing of the same rows; texts against the blocks."""
    words = {r[0]: (r[1] or "").encode().split() for r in corpus()}
    source = {r[0]: r[3] for r in corpus()}
    op = {r.doc_id: r for r in mixing.op1_mix(docs, block_words=16).collect()}
    blocks = mixing.mixed_blocks(docs, block_words=16, shard_slots=50).collect()
    shown, full = {}, {}
    for b in blocks:
        assert all(source[d] == b.source for d in b.doc_ids) and len(b.words) <= 16
        full[b.source] = full.get(b.source, 0) + len(b.words)
        key = (b.source, b["pass"], b.slot)
        assert key not in shown
        shown[key] = (b.shard, tuple(b.words))
    assert len({b.shard for b in blocks}) > 5 and len({b.place for b in blocks}) == len(blocks)
    for s, n in full.items():
        assert n == sum(r.taken for d, r in op.items() if source[d] == s)
    for s in set(source.values()):  # a pass shows each block of the source at most once
        for p in (0, 1):
            own = [w for (x, q, _), (_, w) in shown.items() if (x, q) == (s, p)]
            left = {}
            for d, ws in words.items():
                if source[d] == s:
                    for w in ws:
                        left[w.decode()] = left.get(w.decode(), 0) + 1
            for w in (x for ws in own for x in ws):
                left[w] -= 1
                assert left[w] >= 0
    texts = mixing.mixed_texts(docs.select("doc_id", "text", "lang", "source", "n_chars"), block_words=16, shard_slots=50).collect()
    taken, original = {}, {r[0]: r[1] or "" for r in corpus()}
    for t in texts:
        taken[t.doc_id] = taken.get(t.doc_id, 0) + len(t.text.encode().split())
        assert all(part in original[t.doc_id] for part in t.text.split("\n") if "\n" not in original[t.doc_id])
    assert taken == {d: r.taken for d, r in op.items() if r.taken}
    for shard in {t.shard for t in texts}:
        assert sum(len(t.text.encode().split()) for t in texts if t.shard == shard) == sum(len(w) for s, w in shown.values() if s == shard)
    whole = mixing.mixed_texts(docs.select("doc_id", "text", "lang", "source", "n_chars"), block_words=16, shard_slots=50, by_shard=False).collect()
    per, first = {}, {}
    for t in whole:
        per.setdefault(t.doc_id, []).append(t)
    for t in texts:
        first[t.doc_id] = min(t.shard, first.get(t.doc_id, t.shard))
    assert {d: sum(len(t.text.encode().split()) for t in ts) for d, ts in per.items()} == taken
    assert all(len(ts) <= 2 and min(t.shard for t in ts) == first[d] for d, ts in per.items())
    full = [d for d, r in op.items() if r.taken == 2 * r["size"] > 0]  # taken twice as a whole: twice the text itself
    assert full and all([t.text for t in per[d]] == [original[d].strip()] * 2 for d in full if original[d] == original[d].rstrip())


def test_permutation(spark):
    from pyspark.sql import functions as F

    d = spark.range(37).select(mixing.permuted(F.col("id"), F.lit(37), F.lit("k")).alias("x"), "id")
    assert sorted(r.x for r in d.collect()) == list(range(37))
    assert d.where(mixing.permuted(F.col("x"), F.lit(37), F.lit("k"), inverse=True) != F.col("id")).count() == 0


def test_token_output(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    start, want = 0, []
    for i, text, *_ in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.op7_token_output(docs).collect())) == want
    assert token_output.op7_token_output(empty).collect() == []
    assert token_output.plain_byte_level(t.to_str())
    assert not token_output.plain_byte_level(t.to_str().replace('"add_prefix_space":false', '"add_prefix_space":true'))
    for bits in (5, 11, 16, 17):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 999).astype("u4")
        assert (token_output.unpack(token_output.pack(ids, bits), bits, 101, 777) == ids[101:777]).all()


def test_quality(docs, spark, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(corpus()))] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.op8_quality_rules(docs, labels).collect()}
    assert len(got) == len(corpus())
    for i, text, *_ in corpus():
        w = (text or "").encode().split()
        grams = list(zip(w, w[1:], w[2:], strict=False))
        rep = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 1000 else None
        if rep is not None:
            assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(rep))
            assert got[i].base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    assert quality.binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10)
    assert quality.counts("a\na\n\nb # é") == (5, 5, 1, 1, 0)
    assert quality.op8_quality_rules(empty, labels).collect() == []


def test_quality_cutoffs(spark):
    assert quality.strictest([0] * 12, 1000, 0.01, 0.01) == 0.02 and quality.strictest([0] * 12, 100, 0.01, 0.01) is None
    assert quality.strictest([0, 0, 0, 50] + [0] * 8, 1000, 0.01, 0.01) == 0.7  # what comes after a failure is not tested
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))
    texts = [(i, say(r.randint(60, 200)), "en", 1) for i in range(700)] + [(1000 + i, " ".join(f"{w}#$%&" for w in say(80).split()), "en", 0) for i in range(20)]
    texts += [(2000 + i, say(90), "fr", 1) for i in range(40)] + [(3000, " ".join(f"{w}#$%&" for w in say(80).split()), "fr", 0), (3001, None, None, 0)]
    docs = spark.createDataFrame([t[:3] for t in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(t[0], t[3]) for t in texts], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.op8_quality_rules(docs, labels).collect()}

    def scores(text):
        n, chars, symbols, dup, repeat = quality.counts(text)
        w = max(n, 1)
        return [min(symbols / max(chars, 1), 1), min(dup * 10 / w, 1), repeat / w, min(chars / w / 25, 1), 25 / (n + 25)]

    good = {k: [scores(t) for _, t, lang, q in texts if lang == k and q == 1] for k in ("en", "fr")}
    cut = {(k, i): quality.strictest([sum(s[i] > g for s in v) for g in quality.GRID], len(v), 0.01, 0.05 / 10) for k, v in good.items() for i in range(5)}
    assert cut["en", 0] == 0.02 and all(cut["fr", i] is None for i in range(5))
    for i, t, lang, _ in texts:
        broken = any(cut.get((lang, k)) is not None and s > cut[lang, k] for k, s in enumerate(scores(t)))
        assert got[i].kept == (not got[i].base_failed and not broken)
    assert not got[1000].kept and got[3000].kept and not got[3001].kept


def test_language(spark, empty):
    ship(spark)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op9_language_id(df).join(df.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 200").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (language_id.crc_mod3(r.doc_id) == 1) for r in got)
    assert language_id.op9_language_id(empty).collect() == []
    odd = language_id.identify(spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string"), {})
    assert {r.lang_pred for r in odd.collect()} == {"und"}


def test_language_of_short_texts(spark):
    ship(spark)
    r = random.Random(4)
    vocab = {k: ["".join(r.choices(abc, k=r.randint(3, 7))) for _ in range(60)] for k, abc in (("aa", "abcdefghi"), ("bb", "jklmnopqr"), ("cc", "acegikmoq"))}
    say = lambda k, n: " ".join(r.choices(vocab[k], k=n))
    long = [(i, say(k, 80), k) for i, k in enumerate(["aa", "bb"] * 60)]
    short = [(1000 + i, say("cc", 9), "cc") for i in range(120)] + [(2000 + i, f"{i} !", "dd") for i in range(20)]
    for data in (long + short, [(i, " ".join(t.split()[:9]), k) for i, t, k in long] + short):
        df = spark.createDataFrame(data, "doc_id long, text string, lang string")
        got = language_id.op9_language_id(df).join(df, "doc_id").where("held_out and lang != 'dd'").collect()
        assert {x.lang for x in got} == {"aa", "bb", "cc"} and all(x.lang_pred == x.lang and not x.rejected for x in got)
    assert max(map(len, (t for _, t, k in short))) < 200
    kept = language_id.samples(df.select("text", "lang").union(spark.createDataFrame([(say("cc", 80), "cc")], "text string, lang string")), docs_per_lang=1)
    assert set(kept) == {"aa", "bb", "cc"} and len(kept["cc"]) > 200


def test_secrets(spark, empty):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = df.text.rlike('(?i)token = "[0-9a-f]{40}"')
    got = secrets.scan(df.select("doc_id", "text")).select("n_candidates", "secrets", "redacted", planted.alias("planted")).collect()
    assert all(bool(r.secrets) == r.planted for r in got) and sum(r.planted for r in got) > 50
    assert all(s not in r.redacted for r in got for s in r.secrets)
    assert secrets.op4_secrets(empty).collect() == []


def test_secrets_several_runs(spark):
    r = random.Random(8)
    key = lambda: "".join(r.choices("0123456789abcdef", k=40))
    a, b, c, d, e, f, g, h = (key() for _ in range(8))
    name = "production_database_password"
    odd = {
        1: (f'{{"secret":"{a}","access_key":"{b}"}}', [a, b]),
        2: (f"{name}:{c}", [name, c]),
        3: (f"token:{d}.{e}.{f}", [d, e, f]),
        4: (f"https://x.y/?api_key={g}&auth={h}", [f"api_key={g}", f"auth={h}"]),
        5: (f'token = "{a}" secret: {a}{b}', [a, a + b]),
    }
    rows_ = [(i, t) for i, (t, _) in odd.items()] + [(100 + i, f'token = "{key()}"') for i in range(60)]
    rows_ += [(200 + i, f"see /{''.join(r.choices('aeioulmnrst', k=12))}/{''.join(r.choices('aeioulmnrst', k=12))}/x today") for i in range(60)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    found = {x.doc_id: x.cores for x in df.select("doc_id", secrets.candidates(df.text)["core"].alias("cores")).collect()}
    assert all(found[i] == cores for i, (_, cores) in odd.items())
    got = {x.doc_id: x for x in secrets.scan(df).collect()}
    for i, (_, cores) in odd.items():
        assert set(got[i].secrets) == set(cores) - {name} and got[i].n_candidates == len(cores)
        assert not any(k in got[i].redacted for k in (a, b, c, d, e, f, g, h))
    assert got[2].redacted == name + ":[SECRET]"
    many = spark.createDataFrame([(1, ".".join(["k" * 16] * 20000))], "doc_id long, text string")
    assert many.select(secrets.candidates(many.text).alias("c")).selectExpr("size(c)").first()[0] == 20000


def test_pieces(docs, empty):
    got = pieces.sample_segmentations(docs, samples=3).collect()
    text = {r[0]: r[1] or "" for r in corpus()}
    seen = set()
    for r in got:
        assert r.decoded or "▁" in text[r.doc_id]
        assert (r.doc_id, bytes(r.ids)) not in seen and 0 <= r.inclusion <= 1
        seen.add((r.doc_id, bytes(r.ids)))
    assert {r.doc_id for r in got} == set(text)
    again = pieces.sample_segmentations(docs.repartition(5), samples=3).collect()
    ids = lambda found: sorted((r.doc_id, r.sample, bytes(r.ids)) for r in found)
    assert ids(got) == ids(again)
    assert pieces.op10_pieces(empty).collect() == []


def test_inclusion_is_unbiased():
    import public_tokenizers

    v = pieces.vocabulary(str(public_tokenizers.path("piece_bpe_32k.model")), 0.5)
    got = pieces.sample_texts(v, ["abc"] * 3000, np.arange(3000, dtype="u8"), 2, 7)
    assert np.mean([sum(np.exp(o["log_prob"]) / o["inclusion"] for o in g) for g in got]) == pytest.approx(1, abs=0.03)
    first = [tuple(g[0]["ids"]) for g in got]
    top = max(set(first), key=first.count)
    p = next(np.exp(o["log_prob"]) for g in got for o in g if tuple(o["ids"]) == top)
    assert first.count(top) / 3000 == pytest.approx(p, abs=0.03)


def test_long_chunk(monkeypatch):
    import math

    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    v, sp = pieces.vocabulary(path, 0.5), sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    rng = random.Random(6)
    texts = ["".join(rng.choices("etaoinshrdlu", k=5000)), "short words here", "".join(rng.choices("ab漢é😀x", k=5000)), "".join(rng.choices("the", k=12000))]

    def sampled(longest):
        monkeypatch.setattr(pieces, "LONGEST", longest)
        pieces._lattices.clear()
        return pieces.sample_texts(v, texts, np.arange(len(texts), dtype="u8"), 3, 7)

    try:
        got, uncut, narrow = sampled(pieces.LONGEST), sampled(60000), sampled(64)
    finally:
        pieces._lattices.clear()
    for a, b, c in zip(got, uncut, narrow, strict=True):
        assert [x["ids"].tolist() for x in a] == [x["ids"].tolist() for x in b] == [x["ids"].tolist() for x in c]
        for other in (b, c):
            assert [x["log_prob"] for x in a] == pytest.approx([x["log_prob"] for x in other])
    text = pieces.SPACE + texts[0]  # every character is a piece, so the lattice needs no byte pieces
    beta = [0.0] * (len(text) + 1)
    for s in range(len(text) - 1, -1, -1):
        x = [v.weight[known[text[s:e]]] + beta[e] for e in range(s + 1, min(len(text), s + v.longest) + 1) if text[s:e] in known]
        beta[s] = max(x) + math.log(sum(math.exp(y - max(x)) for y in x))
    for o in got[0]:
        assert o["log_prob"] == pytest.approx(float(v.weight[o["ids"]].sum()) - beta[0], abs=1e-6)
        assert pieces.decode(v, o["ids"]) == texts[0]


def test_empty_tables(empty, spark):
    for f in (suffixes.op2_suffixes, minhash.op5_minhash, substrings.op6_substrings):
        assert f(empty).collect() == []
    assert embeddings.op3_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_chunk_paths_agree():
    import random

    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice(" \nab▁") for _ in range(rng.randint(1, 9)))
        assert pieces.chunks(t) == pieces._CHUNK.findall(pieces.SPACE + t.replace(" ", pieces.SPACE))


def test_pieces_decode(spark):
    ship(spark)
    texts = ["", "ein Haus, das brennt", " two  blanks ", "día 中文 \U0001f600\n\tx", "a" * 5000, None]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    drawn = pieces.sample_segmentations(df, samples=2)
    back = pieces.decode_pieces(drawn.withColumn("TEXT", F.lit("old"))).collect()
    assert {r.doc_id for r in back} == set(range(len(texts))) and len(back) >= len(texts)
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    assert [r.text for r in pieces.decode_pieces(spark.createDataFrame([(None,)], "ids binary")).collect()] == [None]
