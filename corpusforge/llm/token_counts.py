"""Token counts: the tokenizer library encodes in Arrow tasks and only lengths leave them.

Each record batch is cut into slices of about ``batch_bytes`` bytes, so a batch of long
texts costs the memory of a batch of short ones.  Texts are split at safe boundaries
(``pieces``): a text of any length becomes short parts, each distinct part of a slice is
encoded once in one library call, and the text's count is the sum over its parts.

Null and empty texts count 0 tokens and 0 bytes.  Rows with a null id and repeated rows
each give their own row.  Only the id and the text column are read, so further columns
cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusforge.llm.common import byte_slices, keyed_text, loaded, model_bytes
from corpusforge.llm.pieces import CACHE_ENTRIES, PieceCuts, byte_parts

#: Documents with more tokens than this are flagged.
TOKEN_LIMIT = 4096
#: Bytes of text a task encodes at a time.
BATCH_BYTES = 8 << 20


class _PieceCounter:
    """Counts for a sentencepiece model."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.cut = PieceCuts([self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())])
        self.known: dict[str, int] = {}

    def _lengths(self, parts: list[str]) -> list[int]:
        # the library puts a mark before whatever it is given: a part that starts with a space gives
        # that space up for it; one that starts with a line feed is counted without the mark
        ids = self.sp.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [len(x) - (p[0] != " ") if p != " " else 1 for p, x in zip(parts, ids, strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.cut(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*parts).difference(self.known)) if parts else []
        self.known.update(zip(new, self._lengths(new), strict=True) if new else ())
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in parts]


class _JsonCounter:
    """Counts for a tokenizers file; only byte-level vocabularies without a normalizer are split."""

    def __init__(self, data: bytes):
        import json

        from tokenizers import Tokenizer

        spec = json.loads(data)
        self.tok = Tokenizer.from_str(data.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space", True)
        self.known: dict[str, int] = {}

    def _lengths(self, parts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        parts = [byte_parts(t) if self.split and not any(s in t for s in self.special) else [t] * bool(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*parts).difference(self.known)) if parts else []
        self.known.update(zip(new, self._lengths(new), strict=True) if new else ())
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in parts]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens (no begin, end or added special tokens), over_limit."""
    data = model_bytes(path)
    key = ("token counts", hashlib.sha256(data).hexdigest())
    kind = _JsonCounter if path.endswith(".json") else _PieceCounter
    out = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = loaded(key, lambda: kind(data))
        for batch in batches:
            for part in byte_slices(batch, 1, batch_bytes):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = counter.counts(texts)
                cols = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema=pa.schema([part.schema.field(0), *out]))

    slim = keyed_text(docs, id_col, text_col)
    kind_of_id = slim.schema["_id"].dataType.simpleString()
    rows = slim.mapInArrow(run, f"_id {kind_of_id}, n_bytes long, n_tokens long, over_limit boolean")
    return rows.withColumnRenamed("_id", id_col)


