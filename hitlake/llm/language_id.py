"""Language by compression (operator 9).

A language's model is a raw-content zstandard dictionary made of sample texts. A
text's letters, in lower case, are cut into ``chunk``-byte pieces (each compressed alone, so that the
dictionary and not the text's own past decides), and the language whose
dictionary gives the smallest sum wins. ``score`` is 1 - smallest / second
smallest, scaled to 0..1; a text is ``rejected`` where that margin is narrower
than ``min_margin`` or no letter is found.

Null texts and texts without a letter are ``und`` with score 0. With no training
rows everything is ``und``. Ties go to the first language by name. Whole texts
are read, of any length; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words with one space between them: digits, signs and shouting say nothing of the language."""
    return _OTHER.sub(" ", text.lower()).strip()


def held_out(doc_id):
    """Column: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def samples(train: DataFrame, docs_per_lang: int = 200, bytes_per_doc: int = 1500) -> dict[str, bytes]:
    """A dictionary per language from a bounded sample of the training rows.

    ``train``: (text, lang). At most ``docs_per_lang`` distinct texts a language,
    each giving at most ``bytes_per_doc`` characters of sample: these two bounds
    are what the driver holds per language. A longer text gives a slice whose place its
    hash chooses, so any part of a text may teach. Texts of 200 characters or more come
    first, shorter ones fill up where those are missing; samples without a letter
    teach nothing. Texts with the smallest hashes are taken, first within 64 salts,
    so no language gathers in one task.
    """
    h = F.xxhash64("text")
    first = F.pmod(h, F.greatest(F.length("text") - bytes_per_doc, F.lit(0)) + 1).cast("int") + 1
    t = train.where("lang is not null and text is not null").select(
        "lang", (F.length("text") < 200).alias("short"), h.alias("h"), F.substring("text", first, F.lit(bytes_per_doc)).alias("s")
    ).where(F.col("s").rlike(r"\p{L}"))
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("short", "h", "s")
    top = t.withColumn("k", F.row_number().over(salted)).where(F.col("k") <= docs_per_lang).drop("k").distinct()
    whole = Window.partitionBy("lang").orderBy("short", "h", "s")
    rows = top.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= docs_per_lang).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, -r.k)):
        out.setdefault(r.lang, []).append(r.s)
    return {k: " ".join(map(letters, v)).encode() for k, v in out.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], chunk: int = 2048, level: int = 3, min_margin: float = 0.005) -> DataFrame:
    """Add lang_pred, score and rejected to docs, reading only its text column; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    langs = sorted(dictionaries)

    def predict(batches):
        import zstandard as z

        tools = []
        for k in langs:
            d = z.ZstdCompressionDict(dictionaries[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters.from_level(level, window_log=19, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            tools.append(z.ZstdCompressor(dict_data=d, compression_params=p))
        for b in batches:
            pred, score, rejected = [], [], []
            for x in b.column(b.schema.get_field_index("text")):
                text = x.as_py()
                if not text or not langs or not _LETTER.search(text):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                raw = letters(text).encode()
                pieces = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
                sizes = [sum(len(t.compress(p)) for p in pieces) for t in tools]
                best = min(range(len(langs)), key=sizes.__getitem__)
                rest = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best])
                margin = (rest - sizes[best]) / max(rest, 1)
                pred.append(langs[best]), score.append(min(1.0, 4 * margin)), rejected.append(margin < min_margin and len(langs) > 1)
            keep = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*b.schema.names, "lang_pred", "score", "rejected"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{kinds}, lang_pred string, score double, rejected boolean")


def learn(docs: DataFrame) -> dict[str, bytes]:
    own = pick(docs, "doc_id", "text", "lang")
    return samples(own.where(~held_out(F.col("doc_id"))).select("text", "lang"))


def op9_language_id(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    got = identify(pick(docs, "doc_id", "text"), learn(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def crc_mod3(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
