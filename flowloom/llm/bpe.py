"""Byte-level BPE through a SentencePiece model that is written from the vocabulary, not trained."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of


def byte_alphabet() -> list[str]:
    """One printable character for each byte, so that a piece never holds a space or control character."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        rows = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in rows]


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A serialised SentencePiece BPE model: piece id = rank, score = -rank, identity normalisation.

    The unknown piece, which the format wants, comes after the vocabulary.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_alphabet()
    m = pb.ModelProto()
    for rank, token in enumerate(vocabulary):
        m.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = m.trainer_spec, m.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(m.pieces), len(vocabulary), -1, -1, -1
    t.split_by_whitespace = t.split_by_unicode_script = t.split_by_number = t.treat_whitespace_as_suffix = t.byte_fallback = False
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return m.SerializeToString()


class ByteBpe:
    """Encodes pre-tokens with the SentencePiece model, remembering at most ``remember`` of them."""

    def __init__(self, vocabulary: list[bytes], pattern: str, model: bytes | None = None, remember: int = 200_000):
        import regex
        import sentencepiece

        self.vocabulary, self.remember = vocabulary, remember
        self.split = regex.compile(pattern).findall
        self.letters = byte_alphabet()
        self.table = dict(enumerate(self.letters))
        self.whole = {t: (r,) for r, t in enumerate(vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(vocabulary))
        self.seen: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        # a pre-token that is itself in the vocabulary is that token, reachable by merges or not
        ids = self.whole.get(raw) or tuple(self.model.encode(raw.decode("latin-1").translate(self.table)))
        if len(self.seen) >= self.remember:
            self.seen.clear()
        if len(piece) <= 64:
            self.seen[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        seen, add = self.seen.get, out.extend
        for piece in self.split(text):
            add(seen(piece) or self._ids(piece))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and proof that they decode to it.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, on request,
    token_ids (array of int).  No shuffle; each batch
    is encoded by itself.  A null or empty text has no tokens; repeated rows give
    repeated results; an empty table gives none.  The vocabulary is of fixed size
    and travels with the task.
    """
    vocabulary = read_ranks(vocabulary_path)
    model = model_bytes(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, proto = shared.value
        bpe, names = ByteBpe(words, pattern, proto), list(map(str, range(len(words))))
        for b in batches:
            n, ih, dh, lists = [], [], [], []
            for text in b.column("__text").to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                ih.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                dh.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(pa.array(ids, pa.int32()))
            cols = [b.column("__id"), pa.array(n, pa.int64()), pa.array(ih, pa.string()), pa.array(dh, pa.string())]
            names_out = ["__id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
                names_out.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names=names_out)

    src = packed(docs, __id=id_col, __text=text_of(text_col)).select("__id", "__text")
    kind = src.schema["__id"].dataType.simpleString()
    out = src.mapInArrow(go, f"__id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("__id", id_col)
