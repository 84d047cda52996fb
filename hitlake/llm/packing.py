"""Packing documents into sequences of bounded length by best-two-fit (operator 12).

A bin is filled greedily, longest piece first; then its smallest piece gives way to the
two unpacked ones that fill the gap it leaves most tightly, where two fill it better.

Pieces of one length are alike to the packer, so bins are chosen on a histogram: at
most ``most`` counts, however many documents there are. Bins that come out alike are one
pattern with a number of copies (as long as the counts last, the next bin would choose
the same), which bounds the patterns by the sum of most / length over all lengths. The
driver holds these counts and patterns and never a document. Each piece then finds its
place from its rank among the pieces of its length: counted inside its task as texts are
encoded, plus the counts of the tasks before. All of the corpus is one packing; no
bins are lost at partition borders, and no length, however frequent, is one task.

A null text is empty and holds just the end id, so every row has a piece; repeated ids
and rows are packed each on their own; an empty table gives no rows; extra columns are
ignored. Sequence numbers may differ from run to run, the number of sequences may not.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick
from .token_output import byte_chars

#: Units between blanks, and words in them, kept per Python worker; beyond it that cache starts anew.
CACHE_UNITS, CACHE_WORDS = 300_000, 600_000
#: Characters below U+0250 but controls and no-break space: composed as they are, lower-cased one by one.
LATIN = re.compile("[\t\n\r -~¡-ɏ]*")
#: The way of cutting texts in which nothing spans white space (a tokenizer file's pattern, a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_loaded: dict[str, Callable[[str], bytes]] = {}


def cuts_at_spaces(settings: str) -> bool:
    """Whether a tokenizer's file encodes what lies between blanks independently: composed and lower-cased text, cut by ``WORDS``."""
    x = json.loads(settings)
    norm, pre = (((x.get(k) or {}).get(v)) or [] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    plain = [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
    split = [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": WORDS} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    loose = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] or "\n" in a["content"] for a in x["added_tokens"])
    return plain and split and loose and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"] and not (x.get("truncation") or x.get("padding") or x["model"].get("dropout"))


class Known(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def latin_words() -> re.Pattern:
    """``WORDS`` for lower-cased text of ``LATIN`` characters, in which re knows no classes by category."""
    kinds = {k: "".join(c for c in map(chr, range(0x80, 0x250)) if unicodedata.category(c)[0] == k) for k in "LN"}
    letter, number = "a-zA-Z" + kinds["L"], "0-9" + kinds["N"]
    return re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letter}]+|[{number}]|[^\s{letter}{number}]+")


def encoder(path: str):
    """A function text -> ids as little-endian uint32 bytes, without special tokens of the library's own.

    Where the file's settings allow it, a text of Latin characters is cut into words that
    are looked up, and a new word goes to the library's model. Another text is cut at
    blanks, and units with other characters, or with a special token's string, go to the
    library whole; so do all texts of other files.
    """
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = _encoder(Tokenizer.from_file(path))
    return _loaded[path]


def _encoder(tok):
    plain, special = cuts_at_spaces(tok.to_str()), [x.content for x in tok.get_added_tokens_decoder().values()]
    model, table = tok.model, byte_chars()
    mapped = str.maketrans(bytes(range(256)).decode("latin-1"), "".join(table[i] for i in range(256)))
    find, latin = latin_words().findall, LATIN.fullmatch

    def raw(text: str) -> bytes:
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

    def word(w: str) -> bytes:
        text = w if w.isalpha() and w.isascii() else w.encode().decode("latin-1").translate(mapped)
        return array("I", [t.id for t in model.tokenize(text)]).tobytes()

    def unit(u: str) -> bytes:
        if latin(u) and not any(s in u for s in special):
            low = u.lower()
            if latin(low):
                return b"".join(map(words.__getitem__, find(low)))
        return raw(u)

    words, units = Known(word), Known(unit)

    def encode(text: str) -> bytes:
        if not plain:
            return raw(text)
        if len(words) > CACHE_WORDS:
            words.clear()
        if latin(text):
            return unit(text)
        if len(units) > CACHE_UNITS:
            units.clear()
        return b"".join(map(units.__getitem__, text.replace("\n", " ").split(" ")))

    return encode


_PIECES = "part int, doc_id long, piece int, start long, length int, nth long, ids_crc32 long"


def encode_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``most`` ids, written as a table: only longer documents are cut.

    nth is the piece's rank among those of its length in its task (part). With
    ``keep_ids`` the ids themselves are written too.
    """
    names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * keep_ids

    def pieces(batches):
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(most + 1, "i8"), encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array([part] * len(rows), pa.int32()), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]]
            return pa.RecordBatch.from_arrays(made[: len(names)], names=names)

        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for i, at in enumerate(range(0, len(ids), most * 4)):
                    own = ids[at : at + most * 4]
                    n = len(own) // 4
                    rows.append((doc_id, i, at // 4, n, int(seen[n]), zlib.crc32(own), own if keep_ids else None))
                    seen[n] += 1
                if len(rows) >= 4096:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    return cut(pick(docs, "doc_id", "text").mapInArrow(pieces, _PIECES + ", ids binary" * keep_ids))


def fill(left: np.ndarray, there: np.ndarray, most: int) -> dict[int, int]:
    """One bin (length -> pieces) from ``left`` pieces of each length; ``there`` are the lengths that are left, ascending."""
    gap, bin_ = most, {}
    at = len(there)
    while True:  # the longest that fits, as often as it fits
        at = min(at, int(np.searchsorted(there, gap, "right"))) - 1
        if at < 0:
            break
        n = int(there[at])
        bin_[n] = min(gap // n, int(left[n]))
        gap -= n * bin_[n]
    small = min(bin_)
    pair = best_two(left, there, bin_, gap + small) if gap else None
    if pair and sum(pair) > small:
        bin_[small] -= 1
        for n in pair:
            bin_[n] = bin_.get(n, 0) + 1
    return {n: k for n, k in bin_.items() if k}


def best_two(left: np.ndarray, there: np.ndarray, bin_: dict[int, int], gap: int) -> tuple[int, int] | None:
    """Lengths of the two unpacked pieces that fill ``gap`` most tightly, None where no two fit; of equal sums the most unequal."""
    free = left[there].copy()
    for n, k in bin_.items():
        free[np.searchsorted(there, n)] -= k
    a = there[(free > 0) & (there < gap)]
    if not len(a):
        return None
    many = free[np.searchsorted(there, a)] > 1
    b = np.searchsorted(a, np.minimum(gap - a, a), "right") - 1  # the longest partner that is not longer
    own = np.arange(len(a))
    b = np.where((b == own) & ~many, b - 1, b)
    sums = np.where(b >= 0, a + a[b], -1)
    i = len(a) - 1 - int(np.argmax(sums[::-1]))
    return (int(a[i]), int(a[b[i]])) if sums[i] > 0 else None


def patterns(counts: dict[int, int], most: int) -> list[tuple[int, dict[int, int]]]:
    """Bins for ``counts`` pieces of each length: (copies, length -> pieces in a bin)."""
    left, out = np.zeros(most + 1, "i8"), []
    for n, k in counts.items():
        left[n] = k
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        bin_ = fill(left, there, most)
        copies = min(int(left[n]) // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= k * copies
        out.append((copies, bin_))


def places(found: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where pieces go: per run of ranks (of one length, in one pattern) its first rank, pieces a bin, first sequence and offset in it."""
    base, ranks, runs = 0, {}, []
    for copies, bin_ in found:
        offset = 0
        for n, k in sorted(bin_.items(), reverse=True):
            lo = ranks.get(n, 0)
            runs.append((n, lo, k, base, offset))
            ranks[n] = lo + k * copies
            offset += n * k
        base += copies
    cols = np.array(sorted(runs), "i8").reshape(-1, 5).T
    return dict(zip(("length", "lo", "k", "base", "offset"), cols, strict=True))


_PLACED = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"


def place(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """The pieces (a written table of ``encode_pieces``) with sequence_id and offset: best-two-fit over all of them."""
    by = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `most` rows at most
    run = places(patterns(histogram, most))
    keys = run.get("length", np.zeros(0, "i8")) << 40 | run.get("lo", np.zeros(0, "i8"))
    w = Window.partitionBy("length").orderBy("part")  # a row per task that met the length
    before = by.select("part", "length", (F.sum("n").over(w) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]

    def put(batches):
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("length", "rank"))
            at = np.searchsorted(keys, n << 40 | rank, "right") - 1
            copy, slot = np.divmod(rank - run["lo"][at], run["k"][at])
            cols = [pa.array(run["base"][at] + copy), pa.array(run["offset"][at] + slot * n)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *cols], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(put, _PLACED.replace("ids_crc32 long", "ids_crc32 long, ids binary") if "ids" in kept else _PLACED)


def sequences(placed: DataFrame) -> DataFrame:
    """A row per sequence: its ids (little-endian uint32), and what lies where. A group is one sequence, so its size is bounded."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    g = placed.groupBy("sequence_id").agg(own.alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return g.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("offset", "doc_id", "piece", "start", "length")])).alias("pieces"))


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents as packed sequences with their ids."""
    return sequences(place(encode_pieces(docs, tokenizer, most, end_id, keep_ids=True), most))


def op12_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every document's pieces and their place in sequences of 2048 tokens."""
    import public_tokenizers

    return place(encode_pieces(docs, tokenizer or str(public_tokenizers.path("word_bpe_49k.json"))))
