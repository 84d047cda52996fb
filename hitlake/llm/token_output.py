"""Token ids as fixed-width bit-packed binary blocks (operator 7).

File format: a folder of Parquet files, one row per block::

    part, block   place of the block: ascending (part, block) is ascending doc_id
    first_id      ids written before the block
    n_ids, bits   ids in the block, bits per id = bits of the largest vocabulary id
    doc_ids       the documents of the block, in order
    offsets       n + 1 id offsets of the documents inside the block
    payload       ids packed least significant bit first

Any block, and any document in it through ``offsets``, can be unpacked on its own
with numpy. A document is never split, so a block is at least ``block_ids`` long
only where its last document is.

Null texts are empty and hold just the end id; an empty table gives no rows;
repeated ids keep a row each, ordered by text; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick

_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: How byte-level BPE cuts a text before merging (its published pattern, a fixed value).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters are cut here; units of others go through the library's own cutting.
_LATIN = re.compile("[\t\n\r -~¡-ɏ]*")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: ``_CUT`` for them, with their letters and numbers spelled out.
_LATIN_CUT = re.compile(
    _CUT.replace(r"?\p{L}", f"?[{_LETTERS}]").replace(r"?\p{N}", f"?[{_NUMBERS}]").replace(r"\p{L}\p{N}", _LETTERS + _NUMBERS)
)
#: Where a text is split, always between pieces: at a sign after a letter, around a line's end between words, before a space.
_MARK = "\x01"
_MARKS = [(r"([A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~])", rf"\1{_MARK}\2"), (f"([^{_SPACE}])\n([^{_SPACE}])", f"\\1{_MARK}\n{_MARK}\\2")]
#: Texts that are not: a space follows white space (pieces of white space are then longer than one character).
_APART = f"[{_SPACE}] |{_MARK}"
#: Pieces, and units of other characters in texts that are not split, met lately; twice as many at most are kept per Python worker.
CACHE_PIECES, CACHE_UNITS = 400_000, 50_000
#: Bytes of texts that are encoded together (whole texts).
TOGETHER = 4 << 20
_loaded: dict[str, tuple] = {}


def byte_chars() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte: itself, or 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Lately(dict):
    """String -> ids, by ``make`` where it was not met lately.

    When ``most`` strings are in, those met neither since the last such time nor in
    the stretch before it are dropped: most new strings never come again, and
    those that do stay.
    """

    make: Callable[[str], bytes]

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, x: str) -> bytes:
        ids = self.old.get(x)
        if ids is None:
            ids = self.make(x)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[x] = ids
        return ids


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        _loaded[path] = (t, special, Lately(CACHE_PIECES), Lately(CACHE_UNITS), plain_byte_level(t.to_str()), [struct.pack("<I", i) for i in range(t.get_vocab_size(with_added_tokens=True))])
    return _loaded[path]


def plain_byte_level(settings: str) -> bool:
    """Whether a tokenizer's file cuts texts as ``_CUT`` does: byte-level BPE by the published pattern, nothing before it."""
    x = json.loads(settings)
    cut_ = x.get("pre_tokenizer") or {}
    own = cut_.get("type") == "ByteLevel" and not cut_.get("add_prefix_space", True) and cut_.get("use_regex", True)
    return own and x.get("normalizer") is None and x["model"].get("type") == "BPE" and not x["model"].get("dropout")


def encoder(path: str):
    """A function texts -> list of ids as little-endian uint32 bytes; null texts are empty.

    A text is split between pieces, and what is there is looked up once for all texts
    given, which are then put together from the ids found. A new piece goes to the library's
    BPE model; a new unit of other than Latin characters or a text that holds the
    string of a special token goes to the library whole. So does every text where the file's
    settings are not plain byte-level BPE.
    """
    tok, special, pieces, units, plain, packed = _tokenizer(path)
    model, table = tok.model, byte_chars()
    latin1 = bytes(range(256)).decode("latin-1")
    mapped = str.maketrans(latin1, "".join(table[i] for i in range(256)))

    def raw(text: str) -> bytes:
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

    def fresh(w: str) -> bytes:
        plain_letters = w[0] == " " and w.isascii() and w[1:].isalpha()
        own = table[32] + w[1:] if plain_letters else w.encode().decode("latin-1").translate(mapped)
        return b"".join([packed[t.id] for t in model.tokenize(own)])

    def new(x: str) -> bytes:
        if not (x.isascii() or _LATIN.fullmatch(x)):
            return raw(x)
        if x.isalpha() or (x[:1] == " " and x[1:].isalpha()):
            return fresh(x)
        cut = _LATIN_CUT.findall(x)
        return fresh(x) if len(cut) == 1 else b"".join(map(pieces.__getitem__, cut))

    pieces.make, units.make = new, raw

    def apart(text: str) -> bytes:
        us = _UNIT.findall(text)
        ids = {u: pieces[u] if _LATIN.fullmatch(u) else units[u] for u in set(us)}
        return b"".join(map(ids.__getitem__, us))

    def split(texts: pa.Array) -> list[bytes]:
        for where, mark in _MARKS:
            texts = pc.replace_substring_regex(texts, where, mark)
        lists = pc.split_pattern(pc.replace_substring(texts, " ", _MARK + " "), _MARK)
        at = lists.offsets.to_numpy()
        coded = lists.values[at[0] : at[-1]].dictionary_encode()
        code = coded.indices.to_numpy()
        ids = list(map(pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        size = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        n = size[code]
        end = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(size) - size)[code] - end[:-1], n) + np.arange(end[-1])
        flat = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        return [flat[a:z] for a, z in pairwise((4 * end[at - at[0]]).tolist())]

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        col = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        whole = np.full(len(col), not plain)
        for x in special:
            whole |= pc.match_substring(col, x).to_numpy(zero_copy_only=False)
        own = ~(whole | pc.match_substring_regex(col, _APART).to_numpy(zero_copy_only=False))
        out = iter(split(col.filter(pa.array(own))) if own.any() else [])
        return [next(out) if own[i] else (raw if whole[i] else apart)(col[i].as_py()) for i in range(len(col))]

    return encode


def vocab_bits(path: str) -> int:
    tok = _tokenizer(path)[0]
    return max(1, (tok.get_vocab_size(with_added_tokens=True) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = ((ids[:, None] >> np.arange(bits, dtype="u4")) & 1).astype("u1")
    return np.packbits(lanes.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a block, without unpacking what lies before them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}")[start:stop].astype("<u4")
    lo, hi = start * bits, stop * bits
    flat = np.unpackbits(np.frombuffer(payload, "u1")[lo // 8 : (hi + 7) // 8], bitorder="little")
    lanes = flat[lo % 8 : lo % 8 + hi - lo].reshape(-1, bits).astype("u4")
    return (lanes << np.arange(bits, dtype="u4")).sum(axis=1, dtype="u4")


_BLOCKS = "part int, block long, n_ids long, bits int, doc_ids array<long>, offsets array<long>, payload binary"


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = 1 << 16) -> DataFrame:
    """Encode, order by doc_id and write blocks to the shared folder; returns the written table.

    One shuffle: texts are range partitioned by doc_id on sampled splitters, each
    range is sorted and packed as it streams by.
    """
    spark = docs.sparkSession
    bits = vocab_bits(tokenizer)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        part, block = TaskContext.get().partitionId(), 0
        encode, held, size = encoder(tokenizer), [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            offsets = np.cumsum([0, *[len(x[1]) // 4 for x in held]])
            ids = np.frombuffer(b"".join(x[1] for x in held), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([bits], pa.int32()), pa.array([[x[0] for x in held]], pa.list_(pa.int64())),
                 pa.array([offsets], pa.list_(pa.int64())), pa.array([pack(ids, bits)], pa.binary())],
                names=["part", "block", "n_ids", "bits", "doc_ids", "offsets", "payload"],
            )

        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1)
            group = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy()) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for at, to in pairwise(edges):
                for d, ids in zip(ids_of[at:to], encode(texts[at:to]), strict=True):
                    held.append((d, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= block_ids:
                        yield flush()
                        held, size, block = [], 0, block + 1
        if held:
            yield flush()

    return cut(
        pick(docs, "doc_id", "text")
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(blocks, _BLOCKS)
    )


def with_starts(blocks: DataFrame) -> DataFrame:
    """Add first_id, the ids before each block: a running sum inside each part, then over parts."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("inner"))
    starts = inner.join(before, "part").select("part", "block", (F.col("inner") + F.col("before")).alias("first_id"))
    return blocks.join(starts, ["part", "block"])


def read_docs(blocks: DataFrame) -> DataFrame:
    """Read the blocks back: (doc_id, start, n_tokens, ids_crc32, ids binary little-endian uint32)."""

    def docs(batches):
        for b in batches:
            for r in b.to_pylist():
                offs, out = np.array(r["offsets"]), []
                ids = unpack(r["payload"], r["bits"], 0, r["n_ids"])
                out = [ids[a:z].tobytes() for a, z in zip(offs, offs[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(offs[:-1] + r["first_id"], pa.int64()), pa.array(np.diff(offs), pa.int64()),
                     pa.array([zlib.crc32(x) for x in out], pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op7_token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode all documents, write them bit-packed, read them back: digest per document."""
    import public_tokenizers

    path = tokenizer or str(public_tokenizers.path("byte_bpe_50k.json"))
    return read_docs(with_starts(write_blocks(docs, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
