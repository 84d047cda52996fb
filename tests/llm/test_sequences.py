"""Fill-in-middle, packing and the manifest against brute force on small frames with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hitlake.llm import fim, manifest, packing
from hitlake.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, path string, part int, form string"
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))


def corpus() -> list[tuple]:
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choices("abcdeéÉ漢😀'7Σ́", k=r.randint(1, 6))) for _ in range(n))
    texts: list[str | None] = [None, "", " ", "\n\n", "\n", "a", "<P>", "x <S> y", "<M", "a<P", "é 漢字 x😀", "it's  AÅ Å\tB c\x1cd <|endoftext|>x ΑΣ", "Don'T 1234 ...!?"]
    texts += [say(r.randint(1, 120)) for _ in range(60)] + [say(9000), "word " * 700, "same", "same"]
    rows = [(i, t, ["en", "", None, "ü", "z"][i % 5], ["a", None][i % 2], None if i % 9 == 0 else len(t or ""), 1, "p", 2, "f") for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "no id", "en", "a", 5, 1, "p", 2, "f"), (None, None, None, None, None, 1, "p", 2, "f"), (3, "again", "ü", "b", 5, 1, "p", 2, "f")]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5, "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def middle_filled(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim(docs):
    want = [(r[0], *(m := middle_filled(r[0], r[1]))[:4], sha(m[4]), sha(r[1] or "")) for r in corpus()]
    got = fim.op11_fim(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert rows(got) == sorted(want, key=repr) and {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_outputs_and_pieces(docs):
    marks = fim.sentinel_pieces(fim.SENTINELS)[0]
    by = defaultdict(list)
    for r in corpus():
        by[r[0]].append(r[1] or "")
    for r in fim.transform(docs).collect():
        texts = [t for t in by[r.doc_id] if middle_filled(r.doc_id, t)[4] == r.output]
        assert texts
        shown = b"".join((texts[0].encode(), marks)[p.buffer][p.start : p.start + p.length] for p in r.pieces)
        assert shown.decode() == r.output and len(r.pieces) <= 6


def test_fim_other_sentinels(docs, empty):
    own = ("<|pre|>", "<|mid|>", "<|suf|>")
    back = fim.restore(fim.transform(docs, seed="other", transformed_percent=100, spm_percent=50, sentinels=own), own)
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in corpus())
    assert fim.op11_fim(empty).count() == 0
    for bad in (("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x"), ("<M>x", "x<", "c")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)


def test_piece_table_split():
    t = [(0, 5, 3), (1, 0, 2), (0, 9, 4)]
    for at in range(10):
        left, right = fim.split(t, at)
        flat = lambda x: [(b, s + i) for b, s, n in x for i in range(n)]
        assert flat(left) + flat(right) == flat(t) and len(flat(left)) == at and all(n for _, _, n in left + right)


def test_word_cache_is_the_library():
    tok, own = Tokenizer.from_file(WORDS), packing.encoder(WORDS)
    assert packing.cuts_at_spaces(tok.to_str())
    assert not packing.cuts_at_spaces(Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).to_str())
    odd = [chr(c) for c in range(1, 0x260)] + ["İx", "ǅ", "ﬁ ß", "o'clock's 'S", "x²³¼ ª", "<|startoftext|> a", "a\xa0b\x85c"]
    for text in [*(r[1] or "" for r in corpus()), *odd, "a".join(odd), "1".join(odd)]:
        assert np.frombuffer(own(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def library_pieces(most=2048, end=0):
    tok, out = Tokenizer.from_file(WORDS), []
    for r in corpus():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, end]
        for i, at in enumerate(range(0, len(ids), most)):
            own = ids[at : at + most]
            out.append((r[0], i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("most", [2048, 64])
def test_packing(docs, most):
    placed = packing.place(packing.encode_pieces(docs, WORDS, most), most)
    got = placed.collect()
    want = library_pieces(most)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= most
    counts = Counter(w[3] for w in want)
    assert len(by) == len(one_by_one(counts, most)) == sum(c for c, _ in packing.patterns(counts, most))
    assert len(by) <= 1.03 * -(-sum(n * k for n, k in counts.items()) // most) + 1


def one_by_one(counts: dict[int, int], most: int) -> list[list[int]]:
    """Best-two-fit by its definition, piece by piece."""
    left, bins = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True), []
    while left:
        own, gap = [], most
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        small = min(own)
        pairs = {(a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= gap + small} if gap else set()
        best = max(pairs, key=lambda p: (sum(p), p), default=None)
        if best and sum(best) > small:
            own.remove(small)
            left.append(small)
            for n in best:
                left.remove(n)
                own.append(n)
            left.sort(reverse=True)
        bins.append(sorted(own, reverse=True))
    return bins


def test_patterns_are_best_two_fit():
    r = random.Random(2)
    for _ in range(30):
        counts = Counter(r.choices(range(1, 41), weights=[r.random() ** 3 for _ in range(40)], k=r.randint(1, 120)))
        found = [sorted((n for n, k in b.items() for _ in range(k)), reverse=True) for copies, b in packing.patterns(counts, 40) for _ in range(copies)]
        assert found == one_by_one(counts, 40)


def test_patterns_do_not_grow_with_the_corpus():
    r = random.Random(3)
    small = {n: r.randint(1, 50) for n in range(1, 2049)}
    few, many = packing.patterns(small, 2048), packing.patterns({n: k * 10_000_000 for n, k in small.items()}, 2048)
    total = sum(n * k for n, k in small.items()) * 10_000_000
    assert len(many) < 4 * len(few) + 2000 and sum(c for c, _ in many) <= 1.02 * total / 2048


def test_packed_sequences(docs, empty):
    tok, by = Tokenizer.from_file(WORDS), defaultdict(list)
    for s in packing.pack(docs, WORDS, 256).collect():
        ids = np.frombuffer(bytes(s.ids), "<u4")
        assert len(ids) == sum(p.length for p in s.pieces) <= 256
        for p in s.pieces:
            by[p.doc_id, p.start].append(ids[p.offset : p.offset + p.length].tolist())
    for r in corpus():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 256):
            assert ids[at : at + 256] in by[r[0], at]
    assert packing.op12_packing(empty).count() == 0 and packing.pack(empty, WORDS).count() == 0


def h(*xs) -> str:
    return sha("".join(xs))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and each leaf's (siblings left, right) level by level."""
    where, paths, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for i, at in enumerate(where):
            paths[i].append((level[at // 2 * 2 : at], level[at + 1 : at // 2 * 2 + 2]))
        where = [w // 2 for w in where]
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def made(data: list[tuple]) -> list[tuple]:
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: h(show(r[0]), show(r[3]), show(r[2]), show(n), show(r[1]))
    langs, out = defaultdict(list), []
    for r in data:
        hit = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 0
        langs[r[2]].append((leaf(r, r[4]), leaf(r, r[4] + 1 if hit and r[4] is not None else r[4]), r[0]))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for k in names:
        langs[k].sort(key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
    trees = {k: climb([x[0] for x in langs[k]]) for k in names}
    root, tops = climb([trees[k][0] for k in names])
    for k, top in zip(names, tops, strict=True):
        for (own, other, doc_id), path in zip(langs[k], trees[k][1], strict=True):
            at = other
            for left, right in [*path, *top]:
                at = h(*left, at, *right)
            out.append((doc_id, own, trees[k][0], root, h(*(x for a, b in [*path, *top] for x in a + b)), at, at == root))
    return out


def digests(df, block):
    m = manifest.proofs(manifest.manifest(df, manifest.tampering(), block), "instead")
    x = lambda v: bytes(v).hex()
    return sorted(((r.doc_id, x(r.digest), x(r.subroot), x(r.root), r.proof_sha256, x(r.folded_root), r.folded_root == r.root) for r in m.collect()), key=repr)


@pytest.mark.parametrize("block", [2, 4, 16])
def test_manifest_blocks(docs, block):
    want = sorted(made(corpus()), key=repr)
    assert digests(docs, block) == want and {w[-1] for w in want} == {True, False}


def test_manifest(docs, empty):
    assert rows(manifest.op13_merkle_manifest(docs)) == sorted(made(corpus()), key=repr)
    assert manifest.op13_merkle_manifest(empty).count() == 0


def test_manifest_one_group_many_shapes(spark):
    ship(spark)
    for n in (1, 2, 3, 9):
        data = [(i, f"t{i}", "en", "s", 3, 1, "p", 2, "f") for i in range(n)]
        assert digests(spark.createDataFrame(data, SCHEMA), 2) == sorted(made(data), key=repr)


def test_stack_is_the_tree():
    for n in range(1, 40):
        leaves, s = [h(str(i)) for i in range(n)], manifest.Stack()
        for x in leaves:
            s.append(bytes.fromhex(x))
        assert s.close(None).hex() == climb(leaves)[0]
        assert all(manifest.fold(bytes.fromhex(x), bytes(p)).hex() == climb(leaves)[0] for x, p in zip(leaves, s.paths, strict=True))
