"""The encoder's caches: what comes again stays, whatever comes once."""

import random
from array import array
from types import SimpleNamespace

import public_tokenizers
import regex
from tokenizers import Tokenizer

from hitlake.llm import token_output

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_frequent_words_stay(monkeypatch):
    """Words of every text go to the model a few times only, though one-time words fill the caches."""
    for name in ("CACHE_PIECES", "CACHE_UNITS", "CACHE_WORDS"):
        monkeypatch.setattr(token_output, name, 60, raising=False)
    monkeypatch.setattr(token_output, "_loaded", {})
    tok, *others = token_output._tokenizer(PATH)
    calls = []
    counted = SimpleNamespace(tokenize=lambda w: calls.append(w) or tok.model.tokenize(w))
    token_output._loaded[PATH] = (SimpleNamespace(model=counted, encode=tok.encode), *others)
    own = token_output.encoder(PATH)
    for i in range(100):
        once = " ".join("once" + "".join(chr(97 + int(d)) for d in str(i * 20 + k)) for k in range(20))
        text = f"It was the {once} the end"
        assert list(array("I", own([text])[0])) == tok.encode(text, add_special_tokens=False).ids
    assert calls.count("Ġthe") <= 2
    assert len(calls) < 100 * 20 + 50


def test_equals_library_on_random_texts(monkeypatch):
    """All Latin characters and some others, with caches that turn over."""
    for name in ("CACHE_PIECES", "CACHE_UNITS"):
        monkeypatch.setattr(token_output, name, 50, raising=False)
    monkeypatch.setattr(token_output, "_loaded", {})
    own, tok, r = token_output.encoder(PATH), Tokenizer.from_file(PATH), random.Random(7)
    latin = [chr(i) for i in range(0x250) if token_output._LATIN.fullmatch(chr(i))]
    pattern = regex.compile(token_output._CUT)
    for k in range(600):
        some = r.sample(latin, 12) + [*" \n' '", *"stlde1"] + ["　", "\xa0", "語", "’", "\x1c", "\x0b"][: 6 * (k % 3 == 0)]
        text = "".join(r.choices(some, k=80)) if k else "".join(latin)
        assert list(array("I", own([text])[0])) == tok.encode(text, add_special_tokens=False).ids
        if k % 3:
            assert token_output._LATIN_CUT.findall(text) == pattern.findall(text)
