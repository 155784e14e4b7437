"""SentencePiece merge vocabularies: encoding by a prefix table, and decoding.

For every prefix of a text the merge process ends in exactly one last token.  The table
holds it: an automaton over all pieces lists the tokens that end at a position, and a
candidate is the last token if the token that ends the prefix before it and the candidate
stay apart when merged as a pair (or, at the start, if the candidate is the encoding of
its own characters).  That is right because a merge process looks at one neighbourhood
only: the first merge that crosses a boundary between two tokens would also cross it
between these two alone.  The ids are read backwards from the last position.  A character
outside the vocabulary is a token of its own and becomes its UTF-8 bytes' pieces.

Texts are cut at safe boundaries first (``pieces``), so a text of any length needs little
memory, and each distinct part is encoded once per worker cache.

Null counts as empty: an empty text has the end id alone and decodes to an empty text.
Null ids and repeated rows give their own rows.  Only the id and the text column are read,
so further columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusforge.llm.common import byte_slices, keyed_text, loaded, model_bytes
from corpusforge.llm.pieces import MARK, Bounded, PieceCuts

BATCH_BYTES = 8 << 20
#: Answers of the pair test a worker keeps.
PAIR_ENTRIES = 500_000


class PieceCodec:
    """Encoder and decoder for one merge vocabulary with byte fallback and no text normalization."""

    def __init__(self, data: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge vocabularies with byte fallback are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only texts taken as they are, with a dummy prefix, are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.end_id = model.trainer_spec.eos_id
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.piece = [p.piece for p in model.pieces]
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        unknown = model.trainer_spec.unk_surface
        silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.surface = ["" if i in silent else unknown if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ") for i, p in enumerate(model.pieces)]
        self.silent = silent
        self.ends = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.ends.add_word(p.piece, (i, len(p.piece)))
        self.ends.make_automaton()
        self.cut = PieceCuts(list(self.score))
        self.apart: Bounded = Bounded(self._apart, PAIR_ENTRIES)

    def _merged(self, text: str) -> list[str]:
        """The merge process itself, on the few characters of one or two tokens."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _apart(self, pair: int) -> bool:
        """Whether two tokens stay two when they stand side by side; left + 1 is in the high bits, 0 for the text's start or an unknown character."""
        left, right = (pair >> 24) - 1, pair & 0xFFFFFF
        if left < 0:
            return self._merged(self.piece[right]) == [self.piece[right]]
        return self._merged(self.piece[left] + self.piece[right]) == [self.piece[left], self.piece[right]]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part of the normalized text (spaces stand for marks)."""
        text = part.replace(" ", MARK)
        last, size = [-1] * len(text), [1] * len(text)
        apart = self.apart
        for end, (token, length) in self.ends.iter(text):
            if last[end] < 0:
                start = end - length
                if apart[((last[start] + 1 if start >= 0 else 0) << 24) | token]:
                    last[end], size[end] = token, length
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            if last[at] < 0:
                ids.extend(self.id_of_byte[b] for b in reversed(text[at].encode()))
            else:
                ids.append(last[at])
            at -= size[at]
        apart.trim()
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.cut(text) for i in self.encode_part(part)]

    def _joined(self, ids) -> str:
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(held))
                held.clear()
            out.append(self.surface[i])
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: bytes joined to characters (U+FFFD for each broken one), no dummy space."""
        shown = [i for i in ids if i not in self.silent]
        text = self._joined(shown)
        return text[1:] if shown and self.piece[shown[0]].startswith(MARK) else text


def _utf8(raw: bytearray) -> str:
    """Characters of the bytes; each byte that belongs to none gives one U+FFFD."""
    out, at, data = [], 0, bytes(raw)
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Digests:
    """Cached id strings, counts and decoded texts of the parts."""

    def __init__(self, data: bytes):
        self.codec = PieceCodec(data)
        self.known = Bounded(self._of)

    def _of(self, part: str) -> tuple[str, int, str]:
        ids = self.codec.encode_part(part)
        return " ".join(map(str, ids)), len(ids), self.codec._joined(ids)

    def __call__(self, text: str) -> tuple[str, int, str]:
        self.known.trim()
        found = [self.known[p] for p in self.codec.cut(text)]
        end = str(self.codec.end_id)
        ids = " ".join([x[0] for x in found] + [end])
        # the first part starts with the dummy mark, every part ends at a character: decoding part by part is decoding the whole
        return ids, sum(x[1] for x in found) + 1, "".join([x[2] for x in found])[1:]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id, ids (decimal, joined by a space, end id last), n_tokens, decoded."""
    data = model_bytes(path)
    key = ("piece codec", hashlib.sha256(data).hexdigest())

    def run(batches):
        digest = loaded(key, lambda: _Digests(data))
        for batch in batches:
            for part in byte_slices(batch, 1, batch_bytes):
                rows = [digest(t or "") for t in part.column(1).to_pylist()]
                cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["_id", "ids", "n_tokens", "decoded"])

    slim = keyed_text(docs, id_col, text_col)
    rows = slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, ids string, n_tokens long, decoded string")
    return rows.withColumnRenamed("_id", id_col)
