"""Byte-pair encoding with forced boundaries, and decoding.

No merge can cross two neighbouring bytes that stand beside each other in no vocabulary token, so such a pair marks a
certain cut: the fragments between cuts are encoded independently and their ids concatenated. The same holds where the
pre-tokenizer cuts. White space after a visible character is both, which gives a cheap first cut whose chunks repeat
across texts and are remembered; a chunk seen for the first time goes through the pre-tokenizer and is cut at every
forced boundary.

Texts: null counts as empty; an empty text has no ids. A text of any length is encoded whole. Memory per worker is
bounded by ``MEMO`` remembered chunks of at most ``LONG`` characters each.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import arrow_map, narrow, tokenizer_path, worker_state

MEMO = 400_000
LONG = 48

#: White space that is neither space, tab, line feed nor carriage return, by any library's definition.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")
_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others for the characters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class ForcedBoundaryEncoder:
    """Encoder and decoder over one byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.cutter = self.library.pre_tokenizer
        spec = json.loads(self.library.to_str())
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        vocab = {i: t for t, i in spec["model"]["vocab"].items()}
        value = {c: b for b, c in enumerate(byte_alphabet())}
        #: pairs of neighbouring characters inside some token; every other pair is a forced boundary
        self.inside = {t[k : k + 2] for t in vocab.values() for k in range(len(t) - 1)}
        self.bytes_of = [b""] * (max([*vocab, *added, -1]) + 1)
        for i, t in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
        for i, t in added.items():
            self.bytes_of[i] = t.encode()
        self.special = [t for t in added.values()]
        self.fragments: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def fragments_of(self, piece: str) -> list[str]:
        """Split one pre-token, in the byte alphabet, at its forced boundaries."""
        inside, out, start = self.inside, [], 0
        for k in range(len(piece) - 1):
            if piece[k : k + 2] not in inside:
                out.append(piece[start : k + 1])
                start = k + 1
        out.append(piece[start:])
        return out

    def _fragment(self, fragment: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize(fragment)], dtype="<u4").tobytes()
        if len(fragment) <= LONG:
            if len(self.fragments) >= MEMO:
                self.fragments.clear()
            self.fragments[fragment] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a stretch without special tokens."""
        known, out = self.fragments, []
        for piece, _ in self.cutter.pre_tokenize_str(text):
            for fragment in self.fragments_of(piece):
                ids = known.get(fragment)
                out.append(self._fragment(fragment) if ids is None else ids)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        if any(s in chunk for s in self.special):
            ids = np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            ids = self._plain(chunk)
        if len(chunk) <= LONG:
            if len(self.chunks) >= MEMO:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._chunk(text)
        known, out = self.chunks, []
        for chunk in _CHUNK.findall(text):
            ids = known.get(chunk)
            out.append(self._chunk(chunk) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included; ill-formed UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode(errors="replace")


def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder a worker and vocabulary."""
    return worker_state((ForcedBoundaryEncoder, path), lambda: ForcedBoundaryEncoder(path))


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) and ``decoded`` of every text; the texts stay on their partitions, no shuffle."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def make():
        bpe = encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(x.as_py()) for x in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            return pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

        return apply

    return arrow_map(narrow(docs, doc_id="long", text="string"), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of ids and the SHA-256 of ids and of the decoded text.

    Null and empty texts have 0 ids and the digests of no bytes; repeated rows give repeated results; null ids stay null.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def make():
        bpe = encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                count.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return pa.record_batch([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    return arrow_map(narrow(docs, doc_id="long", text="string"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
