"""Byte-level BPE: texts to token ids and back, with the merges done in batched numpy rounds.

Texts are cut at single spaces, where the vocabulary's own pre-tokenisation always cuts, so each
distinct chunk is encoded once and then looked up. New chunks of a slice are encoded together: the
symbols of all their pieces lie in one flat array, and each round merges the lowest-ranked pair of
every piece that still has one.

Null texts count as empty: no ids, and an empty text back. Row order, repeats and other columns
are kept; a column already called ``token_ids`` or ``decoded`` is replaced.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkit as K

#: The splitting pattern of this family of vocabularies, and its white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = "\t\n\x0b\x0c\r\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

CACHE_ENTRIES = 300_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files: themselves, or U+0100 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary file, with the arrays that merging and decoding need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        table = [b""] * self.size
        for s, i in vocab.items():
            table[i] = raw(s)
        for s, i in self.added.items():
            table[i] = s.encode()
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_length = np.array([len(t) for t in table], np.int64)
        self.token_start = np.concatenate(([0], np.cumsum(self.token_length)[:-1]))
        self.splitter = regex.compile(PATTERN)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}  # by what follows a space; the ids include that space

    # --- encoding -------------------------------------------------------------

    def _pair_ranks(self, symbols: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol, by binary search over the sorted keys."""
        out = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[at] == keys) & (piece[:-1] == piece[1:])
            out[:-1][hit] = self.ranks[at[hit]]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece, as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = self._pair_ranks(symbols, piece)
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            ended = lowest == _NONE
            if ended.any():
                done.append((piece[ended], symbols[ended]))
                going = ~ended
                symbols, piece, ranks, lowest = symbols[going], piece[going], ranks[going], lowest[going]
            hit = ranks == lowest
            # In a run such as "aaa" every other pair is taken, from the left.
            at = np.flatnonzero(hit)
            if len(at):
                heads = np.concatenate(([True], np.diff(at) > 1))
                since = at - np.repeat(at[heads], np.diff(np.concatenate((np.flatnonzero(heads), [len(at)]))))
                at = at[since % 2 == 0]
                symbols[at] = self.merged[ranks[at]]
                stay = np.ones(len(symbols), bool)
                stay[at + 1] = False
                symbols, piece = symbols[stay], piece[stay]
        if not done:
            return [b""] * len(pieces)
        where = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])[np.argsort(where, kind="stable")].astype("<u4").tobytes()
        bounds = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(pieces))))) * 4
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _learn(self, new: set[str]) -> None:
        """Put the ids of ``new`` pieces of the splitter into the cache."""
        new = [p for p in new if p not in self.pieces]
        self.pieces.update(zip(new, self.merge([p.encode() for p in new]), strict=True))

    def _whole(self, text: str) -> bytes:
        pieces = self.splitter.findall(text)
        self._learn(set(pieces))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _plain(self, text: str) -> list[str] | None:
        """``text`` cut at its spaces, or None where a space stands beside other white space."""
        if "  " in text:
            return None
        for c in WHITE_SPACE:
            if c in text and (f" {c}" in text or f"{c} " in text):
                return None
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; special tokens in a text count as such."""
        if len(self.chunks) > CACHE_ENTRIES or len(self.pieces) > CACHE_ENTRIES:
            self.chunks, self.pieces = {}, {}
        known = self.chunks.get
        parts: list[list] = []
        missing: set[str] = set()
        for text in texts:
            found: list = []
            parts.append(found)
            for part in self.at_added.split(text) if self.at_added and any(a in text for a in self.added) else [text]:
                if part in self.added:
                    found.append(int(self.added[part]).to_bytes(4, "little"))
                elif (chunks := self._plain(part)) is None:
                    found.append(self._whole(part))
                else:
                    found.append(self._whole(chunks[0]) if chunks[0] else b"")
                    ids = list(map(known, chunks[1:]))
                    if None in ids:
                        new = [c for c, x in zip(chunks[1:], ids, strict=True) if x is None]
                        missing.update(new)
                        found.append(chunks[1:])
                    else:
                        found.append(b"".join(ids))
        if missing:
            split = {c: self.splitter.findall(" " + c) for c in missing}
            self._learn({p for pieces in split.values() for p in pieces})
            piece = self.pieces.__getitem__
            self.chunks.update((c, b"".join(map(piece, pieces))) for c, pieces in split.items())
        chunk = self.chunks.__getitem__
        return [b"".join([x if type(x) is bytes else b"".join(map(chunk, x)) for x in found]) for found in parts]

    # --- decoding -------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; an id outside the vocabulary has none."""
        ids = ids[ids < self.size]
        lengths = self.token_length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.token_start[ids] - (ends - lengths), lengths)
        return self.token_bytes[at].tobytes()


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _encoding(vocabulary: str, text: str):
    """Batches -> batches of slices with ``token_ids``."""

    def work(batch, texts):
        bpe = load(vocabulary)
        column = batch.column(batch.schema.get_field_index(text)).fill_null("").to_pylist()
        yield K.added(batch, token_ids=pa.array(bpe.encode(column), pa.binary()))

    return K.map_slices(text, work)


def _decoding(vocabulary: str, ids: str):
    """Batches -> smaller batches with ``decoded``."""

    def run(batches):
        for batch in batches:
            bpe = load(vocabulary)
            column = batch.column(batch.schema.get_field_index(ids))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [
                    bpe.decode(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)).decode("utf-8", "replace") if x.is_valid else ""
                    for x in column.slice(at, 256)
                ]
                yield K.added(part, decoded=pa.array(texts, pa.string()))

    return run


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``token_ids``: binary, little-endian unsigned 32-bit integers. The file must be on every node."""
    docs = K.without(docs, "token_ids")
    return docs.mapInArrow(_encoding(vocabulary, text), K.schema_with(docs, "token_ids binary"))


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded``: the text of the ids; bytes that are not UTF-8 become U+FFFD. Null ids give an empty text."""
    encoded = K.without(encoded, "decoded")
    return encoded.mapInArrow(_decoding(vocabulary, ids), K.schema_with(encoded, "decoded string"))


def round_trip_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` and ``decoded``, as the two operators do one after the other, in one Python worker per task.

    Chained in one stage they would take two workers for each task, which stay with the executor and hold the vocabulary twice.
    """
    docs = K.without(docs, "token_ids", "decoded")
    encoding, decoding = _encoding(vocabulary, text), _decoding(vocabulary, "token_ids")
    return docs.mapInArrow(lambda batches: decoding(encoding(batches)), K.schema_with(docs, "token_ids binary, decoded string"))
