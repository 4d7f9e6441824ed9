"""Byte-level BPE with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column

#: Distinct matches whose ids a worker keeps; it starts anew beyond that.
KEPT = 300_000
#: Texts whose characters all lie below this are split by a plain character-class form of the pattern.
_PLAIN = 0x250


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def read_lines(spark: SparkSession | None, path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return f.read().splitlines()


def ranks_json(path: str) -> str:
    """A tokenizers definition from a file of base64 tokens and ranks.

    A rank file lists tokens in the order in which they were merged; each token's parts are what merging its bytes by
    the lower ranks leaves.
    """
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, read_lines(None, path))}
    shown = byte_characters()
    name = lambda t: "".join(shown[b] for b in t)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append([name(parts[0]), name(parts[1])])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name(t): r for t, r in ranks.items()}, "merges": merges},
    })


def _class(kind: str) -> str:
    """Body of a character class: the characters below _PLAIN of a Unicode general category, or white space."""
    chosen = [c for c in range(_PLAIN) if (regex.match(r"\s", chr(c)) if kind == "s" else unicodedata.category(chr(c))[0] == kind)]
    return "".join(f"\\u{c:04x}" for c in chosen)


def plain_pattern(pattern: str) -> str:
    """The same pattern for Python's re, right for texts below _PLAIN."""
    letters, numbers, space = _class("L"), _class("N"), _class("s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return out.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")


class _Known(dict):
    """Ids of matches, as bytes. A match that is not here is merged by the tokenizer's model when it is asked for, and
    stays from the second time on, so that matches seen once, the most of them, take no room."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenize = tokenizer.model.tokenize
        self.once: set[str] = set()
        self.shown = dict(enumerate(byte_characters()))

    def __missing__(self, match: str) -> bytes:
        # Bytes as Latin-1 characters, so that one translation gives the byte-level spelling.
        tokens = self.tokenize(match.encode().decode("latin-1").translate(self.shown))
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if match in self.once:
            self.once.discard(match)
            self[match] = ids
        else:
            self.once.add(match)
        return ids

    def trim(self) -> None:
        if len(self) > KEPT:
            self.clear()
        if len(self.once) > KEPT:
            self.once.clear()


class Encoder:
    """Ids of whole texts, each match of the pattern separately; a distinct match is merged once.

    encode() gives little-endian unsigned 32-bit ids as bytes. As in the library, the strings of the definition's added
    tokens stand for those tokens, the longest at the leftmost place, and what lies between them is split on its own; a
    definition made of ranks has none, so all its text is ordinary.
    """

    def __init__(self, definition: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(definition)
        added = json.loads(definition).get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip, or that only match words or normalized text, are not handled")
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.any, self.plain = regex.compile(pattern), re.compile(plain_pattern(pattern))
        self.beyond = re.compile(f"[^\\x00-{chr(_PLAIN - 1)}]")
        self.known = _Known(self.tokenizer)

    def split(self, text: str) -> list[str]:
        return (self.plain if text.isascii() or not self.beyond.search(text) else self.any).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            self.known.trim()
            if self.marks and self.marks.search(text):
                parts = self.marks.split(text)
                out.append(b"".join(self.added[x] if i % 2 else self._plain_ids(x) for i, x in enumerate(parts)))
            else:
                out.append(self._plain_ids(text))
        return out

    def _plain_ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """(tokens, 2): the first character and the end of each of a text's ids; a token within a character spans all of it."""
        if not hasattr(self, "_lengths"):
            self._lengths = np.array([len(t) for t in self.bytes_of()], np.int64)
        end = np.cumsum(self._lengths[np.frombuffer(ids, "<u4")])
        data = np.frombuffer(text.encode(), np.uint8)
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        return np.stack([begun[start + 1] - 1, begun[end]], axis=1) if len(end) else np.empty((0, 2), np.int64)

    def bytes_of(self) -> list[bytes]:
        """The bytes of each id, by reversing the byte table."""
        if not hasattr(self, "_bytes"):
            back = {c: b for b, c in enumerate(byte_characters())}
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self._bytes = [b""] * (max(vocab.values()) + 1)
            for t, i in vocab.items():
                self._bytes[i] = bytes(back[c] for c in t)
            for t, i in self.added.items():
                at = struct.unpack("<I", i)[0]
                self._bytes += [b""] * (at + 1 - len(self._bytes))
                self._bytes[at] = t.encode()
        return self._bytes

    def decode(self, ids: bytes) -> bytes:
        """Characters that tokens split come together again, as bytes are joined before anything reads them."""
        return b"".join(map(self.bytes_of().__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[int, Encoder] = {}


def encoder(definition: str, pattern: str) -> Encoder:
    """One for each worker process, kept across tasks."""
    key = hash((definition, pattern))
    if key not in _encoders:
        _encoders[key] = Encoder(definition, pattern)
    return _encoders[key]


def definition_of(path: str) -> tuple[str, str]:
    """(tokenizers definition, pattern): path is a .tiktoken rank file or a tokenizers .json; the pattern is the public one."""
    import public_tokenizers

    if path.endswith(".tiktoken"):
        return ranks_json(path), public_tokenizers.PATTERN
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    d["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(d), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """(doc_id, ids, offsets, decoded) of every row of docs: ids as little-endian unsigned 32-bit integers in binary, the
    first character and the end of each token, likewise, and the bytes that the ids decode to.

    A null text counts as empty and has no ids; repeated rows are encoded alike; extra columns are ignored; an empty
    table gives no rows. Texts are taken whole, of any length and in any script.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition_of(path))
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = enc.encode(part.column("text").to_pylist())
                back = [enc.decode(i) for i in ids] if decoded else [None] * len(ids)
                spans = [enc.offsets(t, i).astype("<u4").tobytes() for t, i in zip(part.column("text").to_pylist(), ids)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(spans, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "offsets", "decoded"])

    return docs.mapInArrow(run, "doc_id long, ids binary, offsets binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256), the digests of what encode() gives; hashed beside the
    encoding, so ids stay in the worker. Rows are treated as in encode()."""
    shared = docs.sparkSession.sparkContext.broadcast(definition_of(path))
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = part.column("text").to_pylist()
                ids = enc.encode(texts)
                digest = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
                spans = (enc.offsets(t, i).astype("<u4").tobytes() for t, i in zip(texts, ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), digest(ids), digest(map(enc.decode, ids)), digest(spans)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"],
                )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
