"""Language identification by compression.

A text is encoded with one zstandard raw-content dictionary for each language; the smallest encoding names the
language. A narrow margin between the two smallest encodings is a rejection.

Defined results:
- text null, empty or without any letter: language `und`, score 0, rejected
- encodings of equal size: the language that sorts first, rejected
- no training rows at all: every text is `und`, score 0, rejected
- repeated rows and null ids: each row is judged on its text alone
- a text of any length is one row, encoded block by block
- columns of the input named like an output column are replaced; all others are carried along, whatever their names
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import append_columns, sample_by_hash

UNKNOWN = "und"
#: Documents of a language that its dictionary is taken from, and the bytes that they share evenly.
SAMPLE_DOCUMENTS = 64
DICTIONARY_BYTES = 32768
#: Texts are encoded in blocks, so that a dictionary counts at the end of a long text as much as at its start.
BLOCK_BYTES = 4096
#: The bytes of a stretch of a training text: its share is taken in such stretches from all over the text.
STRETCH = 128
#: A margin under this share of the second smallest encoding is narrow.
NARROW = 0.002

#: One search for texts of every length: the library's most thorough strategy, btultra2, as short encodings are too alike for faster ones.
SEARCH = {"strategy": 9, "min_match": 3, "search_log": 7}

LETTER = re.compile(r"[^\W\d_]")
#: ASCII digits, punctuation and controls say nothing of the language.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normalise(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(PLAIN)


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language."""

    dictionaries: dict[str, bytes]
    narrow: float = NARROW

    def classifier(self):
        """A function from a text to (language, score, rejected)."""
        import zstandard as zstd

        made = []
        for lang in sorted(self.dictionaries):
            content = zstd.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            params = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, write_checksum=False, write_content_size=False, write_dict_id=False, window_log=17, hash_log=15, chain_log=15, **SEARCH)
            content.precompute_compress(compression_params=params)
            made.append((lang, zstd.ZstdCompressor(dict_data=content, compression_params=params)))

        def classify(text: str | None) -> tuple[str, float, bool]:
            if not text or not LETTER.search(text) or not made:
                return UNKNOWN, 0.0, True
            data = normalise(text)
            blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
            sizes = sorted((sum(len(encoder.compress(b)) for b in blocks), lang) for lang, encoder in made)
            best, lang = sizes[0]
            if len(sizes) == 1:
                return lang, 1.0, False
            # a byte more is taken as half as likely
            score = 1.0 / sum(math.pow(2.0, best - size) if size - best < 60 else 0.0 for size, _ in sizes)
            gap = sizes[1][0] - best
            return lang, score, gap <= self.narrow * sizes[1][0]

        return classify


def shared_evenly(texts: list[bytes], room: int) -> bytes:
    """Parts of all texts in their order, a line each: each text gets an even share, and what short ones leave goes to the others."""
    shares = [0] * len(texts)
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        shares[i] = min(len(texts[i]) + 1, room // (len(texts) - done))
        room -= shares[i]
    return b"".join(stretches(text, share - 1) + b"\n" for text, share in zip(texts, shares, strict=True) if share)


def stretches(text: bytes, room: int) -> bytes:
    """room bytes of a text: stretches that lie evenly all over it."""
    if len(text) <= room:
        return text
    n = -(-room // STRETCH)
    sizes = [(i + 1) * room // n - i * room // n for i in range(n)]
    return b"".join(text[at : at + size] for i, size in enumerate(sizes) for at in [i * (len(text) - size) // max(1, n - 1)])


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_documents: int = SAMPLE_DOCUMENTS, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """Dictionaries from a bounded sample: sample_documents documents of each language among the usable rows.

    The sample is drawn over ids alone; the texts are fetched for those ids only.
    """
    labelled = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = [r[0] for r in sample_by_hash(labelled.select(id_col, lang_col), id_col, lang_col, sample_documents).select(id_col).collect()]
    # of an id that several rows have, one text in each language, so what is fetched is bounded by the sample
    rows = labelled.filter(F.col(id_col).isin(ids)).groupBy(id_col, lang_col).agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), text_col))).collect() if ids else []
    texts: dict[str, list[bytes]] = {}
    for _, lang, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        texts.setdefault(lang, []).append(normalise(text))
    content = {lang: shared_evenly(own, dictionary_bytes) for lang, own in texts.items()}
    return LanguageModel({lang: x for lang, x in content.items() if len(x) >= 8})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score and rejected."""

    def make():
        classify = model.classifier()

        def work(texts):
            found = [classify(t) for t in texts]
            return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]

        return work

    return append_columns(docs, [text_col], [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")], make, keep)
