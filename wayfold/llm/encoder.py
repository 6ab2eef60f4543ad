"""Exact, cached encoding of whole texts with a word-level BPE file of the tokenizers library."""

from __future__ import annotations

import functools
import json
import os
import struct

import numpy as np

#: ASCII marks that never join a preceding letter or digit into one pre-token.
_MARKS = b'.,!?;:#$%&*|"()-'
#: Letters before this one compose with none and are folded alike by every Unicode version.
_PLAIN = "\u0250"
#: The characters that stand for bytes in a byte-level vocabulary, by byte.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


@functools.lru_cache(2)
def _kept(path: str, most: int, state: tuple) -> ChunkEncoder:
    return ChunkEncoder(path, most)


def kept(path: str, most: int = 600_000) -> ChunkEncoder:
    """The encoder of a file, loaded once a worker process: later tasks find the vocabulary and the chunks of earlier ones."""
    at = os.stat(path)
    return _kept(path, most, (at.st_mtime_ns, at.st_size))


class ChunkEncoder:
    """Encodes texts by their chunks between spaces and line feeds, each encoded once and remembered.

    Exact for tokenizers that drop white space before BPE and have no special token with white space in it (checked on
    loading): no merge, special token or canonical composition then spans a chunk border. `most` bounds the remembered chunks
    (two generations of `most`/2; the older one is forgotten first), so memory doesn't grow with the corpus.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pattern = (((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex", "")
        lower = any(x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        #: White space is dropped and letters are folded: chunks are independent.
        self.by_chunk = lower and r"[^\s\p{L}\p{N}]+" in pattern and not any(x["lstrip"] or x["rstrip"] or x["content"].split() != [x["content"]] for x in spec.get("added_tokens", []))
        self.openings = {x["content"].encode()[:2] for x in spec.get("added_tokens", [])}
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.model = self.tokenizer.model
        last = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1]
        #: The model sees bytes as characters, with nothing put before them: a run of letters is one word of it.
        self.by_letters = self.by_chunk and last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and r"[\p{L}]+" in pattern and len(spec["pre_tokenizer"]["pretokenizers"]) == 2
        self.code = "<%dH" if self.dtype.itemsize == 2 else "<%dI"
        self.half, self.young, self.old = most // 2, _Chunks(self), {}

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(self.code % len(ids), *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, chunk: bytes) -> str | None:
        """The model's word for a chunk of letters before _PLAIN only, else None."""
        text = chunk.decode().lower()
        if text.isalpha() and max(text) < _PLAIN:
            return text.encode().decode("latin-1").translate(_SHOWN)
        return None

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk that isn't in the younger generation."""
        if (ids := self.old.get(chunk)) is None:
            if chunk.isalpha() and chunk.isascii() and chunk.islower():
                ids = self._bytes([x.id for x in self.model.tokenize(chunk.decode())])
            elif self.by_letters and chunk and (word := self._letters(chunk)):
                ids = self._bytes([x.id for x in self.model.tokenize(word)])
            else:
                core = chunk.rstrip(_MARKS)
                if core and core != chunk and b"<|" not in chunk and (core[-1:].isalnum() or self.by_letters and self._letters(core)):
                    ids = self.young[core] + self.young[chunk[len(core) :]]
                else:
                    ids = self._whole(chunk.decode()) if chunk else b""
        if len(chunk) <= 64:
            if len(self.young) >= self.half:
                self.old = dict(self.young)
                self.young.clear()
            self.young[chunk] = ids
        return ids

    def chunks(self, text: bytes) -> list[bytes]:
        if not any(x in text for x in self.openings):
            text = text.lower()  # ASCII letters only; the library folds the others
        return text.replace(b"\n", b" ").split(b" ")

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned integers of `dtype`."""
        if not self.by_chunk:
            return self._whole(text.decode())
        return b"".join(map(self.young.__getitem__, self.chunks(text)))

    def count(self, text: bytes) -> int:
        if not self.by_chunk:
            return len(self._whole(text.decode())) // self.dtype.itemsize
        return sum(map(len, map(self.young.__getitem__, self.chunks(text)))) // self.dtype.itemsize


class _Chunks(dict):
    def __init__(self, encoder: ChunkEncoder):
        self.encoder = encoder

    def __missing__(self, chunk: bytes) -> bytes:
        return self.encoder._chunk(chunk)
