"""SentencePiece encoding and decoding through a table of distinct chunks.

In the models used here no piece holds a white-space marker after another character (`crosses_markers` checks that), so
no merge can cross the start of a marked word. A text is cut there; each task keeps a table of the distinct marked words
that it has met, has the library segment each of them once, and joins the ids back by position. The table is dropped
when it reaches TABLE_CHUNKS, so its memory is bounded; a global table would need a shuffle of every word's position.

Defined results: a null text counts as empty, which has no ids and decodes to the empty string. Repeated rows are encoded
alike. Extra columns are carried along or ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import map_texts, table

MARK = "▁"
TABLE_CHUNKS = 200_000
#: Chunks longer than this are not kept in the table.
LONG_CHUNK = 200
MODEL = "piece_bpe_32k.model"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def crosses_markers(processor) -> bool:
    """Whether any piece has a marker after another character."""
    return any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


class ChunkTable:
    """Ids and decoded text of distinct marked words."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if crosses_markers(self.processor):
            raise ValueError("pieces of this model can cross white-space markers")
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def segment(self, chunks: list[str]) -> None:
        """Add chunks to the table: their ids, packed, and what these decode to."""
        # The library sets one marker before what it is given, unless that is empty: hand over each chunk without its first.
        mark = self.processor.piece_to_id(MARK)
        found = [x or [mark] for x in self.processor.encode([c[1:] for c in chunks], num_threads=1)]
        # Decoding drops a marker at the very start only; with one id in front, every chunk keeps its own.
        decoded = self.processor.decode([[mark, *x] for x in found]) if found else []
        for c, x, d in zip(chunks, found, decoded, strict=True):
            self.ids[c] = np.array(x, np.int32).tobytes()
            self.decoded[c] = d

    def run(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """For each text, its ids as packed int32, and the text that they decode to."""
        cut = [_chunks(t) for t in texts]
        if len(self.ids) > TABLE_CHUNKS:
            self.ids.clear()
            self.decoded.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.ids))
        self.segment(new)
        get, say = self.ids.__getitem__, self.decoded.__getitem__
        ids = [b"".join(map(get, c)) for c in cut]
        decoded = ["".join(map(say, c))[1:] for c in cut]
        for c in new:
            if len(c) > LONG_CHUNK:
                del self.ids[c], self.decoded[c]
        return ids, decoded


def _chunks(text: str) -> list[str]:
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" in words:
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in words]


_tables: dict[str, ChunkTable] = {}


def chunk_table(model_file: str) -> ChunkTable:
    """One table for each Python worker and model."""
    if model_file not in _tables:
        _tables[model_file] = ChunkTable(model_file)
    return _tables[model_file]


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_decode(df: DataFrame, model_file: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in `carry` (all, by default) in the struct `row`, `ids` (array of int) and `decoded` (string). No shuffle."""
    model_file = model_file or public_model()

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        chunks = chunk_table(model_file)
        texts = batch.column("text").fill_null("").to_pylist()
        ids, decoded = chunks.run(texts)
        offsets = np.cumsum([0, *map(len, ids)]) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), "decoded": pa.array(decoded, pa.string())}

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_texts(df, kernel, fields, df.columns if carry is None else carry, text=text)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
