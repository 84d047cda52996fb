"""Null and repeated ids: a row each, judged by its text."""

import hashlib
import zlib

import numpy as np
import pytest
from test_operators import SCHEMA, corpus

from hitlake.llm import minhash, mixing, quality, substrings, suffixes, token_output
from hitlake.llm.common import ship

# every third row without an id, the others two by two with one
ROWS = [(None if i % 3 == 0 else i // 2, *r[1:]) for i, r in enumerate(corpus())]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "text")


def ordered(rows):
    return sorted(rows, key=repr)


def ids(rows):
    return ordered(r.doc_id for r in rows)


def words(text):
    return (text or "").encode().split()


def test_suffixes(docs):
    plain = suffixes.brute([(i, r[1]) for i, r in enumerate(ROWS)])
    got = suffixes.op2_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered((ROWS[x[0]][0], *x[1:]) for x in plain)


def test_substrings(docs):
    got = substrings.op6_substrings(docs).collect()
    assert ids(got) == ordered(r[0] for r in ROWS)
    assert ordered((r.doc_id, r.n_words) for r in got) == ordered((r[0], len(words(r[1]))) for r in ROWS)
    whole = {hashlib.sha256(b" ".join(words(r[1]))).hexdigest(): len(words(r[1])) for r in ROWS}
    assert all(whole[r.kept_sha256] == r.n_words for r in got if r.n_removed == 0)
    assert sum(r.n_removed == r.n_words > 0 for r in got) >= 2  # of three equal texts two go whole, in whatever order


def test_minhash(docs):
    def size(text):
        w = words((text or "").lower())
        return len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else len(w)

    got = minhash.op5_minhash(docs).collect()
    assert ordered((r.doc_id, r.n_shingles) for r in got) == ordered((r[0], size(r[1])) for r in ROWS)
    assert all(r.component_id is None or r.doc_id is None or r.component_id <= r.doc_id for r in got)


def test_token_output(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = []
    for i, text, *_ in ROWS:
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(x), zlib.crc32(x.tobytes())))
    got = sorted(token_output.op7_token_output(docs).collect(), key=lambda r: r.start)
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered(want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.op8_quality_rules(docs, labels).collect()
    assert ordered((r.doc_id, r.n_words) for r in got) == ordered((r[0], len(words(r[1]))) for r in ROWS)
    assert not any(r.kept and r.base_failed for r in got)


def test_mixing(docs):
    got = mixing.op1_mix(docs, block_words=16).collect()
    assert ordered((r.doc_id, r.size) for r in got) == ordered((r[0], len(words(r[1]))) for r in ROWS)
    assert all(r.taken <= 2 * r.size for r in got)
