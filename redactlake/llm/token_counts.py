"""Token counts by rank-synchronous array merging.

The texts of a slice are one byte buffer. Class arrays over its characters give the borders of all
pre-tokens at once: whether one starts at a character depends only on its neighbours' classes. Each
distinct pre-token that is not known yet joins a ragged array (symbols of all sequences end to end,
and where each sequence starts); a step applies the lowest-ranked pair of every sequence at the
same time, wherever it stands in it, and only the pairs beside merged symbols are ranked again.
A sequence without a ranked pair is finished; the symbols it has left are its tokens.

Pre-tokens are known by 64-bit hashes of their bytes; two distinct ones of a worker's lifetime are
mistaken for each other with a chance of about n*n / 2**65.

Null and empty texts have no byte and no token. Row order, repeats and other columns are kept; columns
already called like a result are replaced. Texts of any length are counted whole. An empty table
gives no row.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: The endings that stay together with an apostrophe before them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The white space of the splitting rule.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"

LETTER, DIGIT, BLANK, OTHER = 1, 2, 3, 4
KNOWN_ENTRIES = 1 << 20
SLICE_BYTES = 2 << 20
_NONE = np.iinfo(np.int64).max


def character_classes() -> np.ndarray:
    """The class of every code point.

    Letters and digits that Python's tables do not have yet depend on the library's Unicode version,
    so its own splitter is asked for those.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    by_category = {"L": LETTER, "N": DIGIT}
    everything = list(map(chr, range(0x110000)))
    category = [unicodedata.category(c) for c in everything]
    out = np.fromiter((by_category.get(c[0], OTHER) for c in category), np.uint8, len(category))
    out[[ord(c) for c in BLANKS]] = BLANK
    newer = regex.compile(r"[\p{L}\p{N}]")
    for c in (c for c, known in zip(everything, category, strict=True) if known == "Cn" and newer.match(c)):
        if len(split("a" + c)) == 1:
            out[ord(c)] = LETTER
        elif len(split("1" + c)) == 1:
            out[ord(c)] = DIGIT
    return out


class Ragged:
    """Sequences of symbols end to end: those of sequence ``i`` begin at ``start[i]``, the next begin where they end."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values = values
        self.lengths = lengths

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths


class TokenCounter:
    """A byte-level vocabulary file, ready to count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
            raise ValueError(f"{path} is no byte-level vocabulary without a leading space")
        vocab = spec["model"]["vocab"]
        size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        joined = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        keys = joined[:, 0] * size + joined[:, 1]
        self.size = size
        self.rank_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.rank_order]
        self.merged = joined[:, 2]
        self.byte_symbol = np.array([vocab[c] for c in _stand_ins()], np.int64)
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.classes = character_classes()
        self.known_hash = np.zeros(0, np.uint64)
        self.known_count = np.zeros(0, np.int64)

    # --- pre-tokens -----------------------------------------------------------------

    def _specials_in(self, texts: K.Texts) -> np.ndarray:
        """(first byte, end byte) of the special strings, from the left, none over the end of a text."""
        raw, found = None, []
        for word in self.specials:
            raw = texts.data.tobytes() if raw is None else raw
            at = raw.find(word)
            while at >= 0:
                text = np.searchsorted(texts.bounds, at, "right")
                if at + len(word) <= texts.bounds[text]:
                    found.append((at, at + len(word)))
                    at = raw.find(word, at + len(word))
                else:
                    at = raw.find(word, at + 1)
        taken, upto = [], 0
        for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
            if a >= upto:
                taken.append((a, b))
                upto = b
        return np.array(taken, np.int64).reshape(-1, 2)

    def spans(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, special): the byte spans of all pre-tokens, and whether each is a special string."""
        data = texts.data
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte each character begins at
        n = len(lead)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        kind = self.classes[_code_points(data, lead)]
        special = self._specials_in(texts)
        # Nothing reaches over the border of a text or of a special string.
        border = np.zeros(n + 1, bool)
        border[np.searchsorted(lead, texts.bounds)] = True
        border[np.searchsorted(lead, special.ravel())] = True
        before = np.empty(n, np.uint8)
        before[0] = 0
        before[1:] = kind[:-1]
        before[border[:-1]] = 0
        after = np.empty(n, np.uint8)
        after[-1] = 0
        after[:-1] = kind[1:]
        after[border[1:]] = 0
        space_before = np.empty(n, bool)
        space_before[0] = False
        space_before[1:] = data[lead[:-1]] == 32
        space_before &= before == BLANK
        # A run of one class is one pre-token, with one space before it; of several blanks the last is apart.
        starts = kind != before
        starts &= ~space_before
        blank = kind == BLANK
        starts |= blank & ((before != BLANK) | ((after != 0) & (after != BLANK)))
        self._split_endings(data, lead, kind, before, space_before, border, starts)
        starts |= border[:-1]
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, np.searchsorted(lead, special[:, 0]), 1)
        np.add.at(inside, np.searchsorted(lead, special[:, 1]), -1)
        within = np.cumsum(inside[:-1]) > 0
        starts &= ~within | border[:-1]
        at = np.flatnonzero(starts)
        start = lead[at]
        return start, np.append(start[1:], len(data)), within[at]

    def _split_endings(self, data, lead, kind, before, space_before, border, starts) -> None:
        """Where an apostrophe begins a pre-token, keep a listed ending with it, and begin anew behind that."""
        at = np.flatnonzero((data[lead] == 39) & (before != OTHER) & ~space_before)
        n = len(lead)
        for ending in ENDINGS:
            size = len(ending)
            fits = at[at + size < n]
            for i, c in enumerate(ending.encode(), 1):
                fits = fits[(data[lead[fits + i]] == c) & ~border[fits + i]]
            starts[fits + 1] = False
            behind = fits + size + 1
            starts[behind[behind < n]] = True
            at = np.setdiff1d(at, fits, assume_unique=True)

    # --- merging -----------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.rank_order[at], _NONE)

    def surviving(self, sequences: Ragged) -> np.ndarray:
        """How many symbols each sequence (of bytes) has left when no pair of it can be merged."""
        counts = sequences.lengths.copy()
        if not len(self.pair_keys):
            return counts
        who = np.flatnonzero(counts > 1)
        lengths = counts[who]
        symbols = self.byte_symbol[sequences.values[np.repeat(counts > 1, counts)]]
        # rank[k]: of the pair that begins at symbol k; none begins at the last symbol of a sequence.
        rank = np.full(len(symbols), _NONE)
        if len(symbols):
            rank[:-1] = self._ranks(symbols[:-1], symbols[1:])
            rank[np.cumsum(lengths) - 1] = _NONE
        while len(who):
            start = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, start)
            going = lowest != _NONE
            if not going.all():
                counts[who[~going]] = lengths[~going]
                keep = np.repeat(going, lengths)
                symbols, rank = symbols[keep], rank[keep]
                who, lengths, lowest = who[going], lengths[going], lowest[going]
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            hit = _from_the_left(hit)
            symbols[hit] = self.merged[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            owner = np.repeat(np.arange(len(who)), lengths)
            lengths = lengths - np.bincount(owner[hit], minlength=len(who))
            place = np.cumsum(stay) - 1
            hit = place[hit]
            symbols, rank = symbols[stay], rank[stay]
            # Only pairs with a merged symbol have changed.
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(lengths) - 1] = True
            changed = np.union1d(hit, hit[hit > 0] - 1)
            changed = changed[~last[changed]]
            rank[changed] = self._ranks(symbols[changed], symbols[changed + 1])
            rank[last] = _NONE
        return counts

    def _counts_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; each distinct one is merged once in a worker's life."""
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known_hash, distinct), max(len(self.known_hash) - 1, 0))
        known = self.known_hash[at] == distinct if len(self.known_hash) else np.zeros(len(distinct), bool)
        counts = np.zeros(len(distinct), np.int64)
        counts[known] = self.known_count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, lengths = start[first[new]], (end - start)[first[new]]
            where = np.arange(int(lengths.sum())) + np.repeat(a - (np.cumsum(lengths) - lengths), lengths)
            counts[new] = self.surviving(Ragged(data[where], lengths))
            if len(self.known_hash) + len(new) > KNOWN_ENTRIES:
                self.known_hash, self.known_count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(new) <= KNOWN_ENTRIES:
                both = np.concatenate((self.known_hash, distinct[new]))
                order = np.argsort(both, kind="stable")
                self.known_hash = both[order]
                self.known_count = np.concatenate((self.known_count, counts[new]))[order]
        return counts[which]

    def count(self, texts: K.Texts) -> np.ndarray:
        """Tokens of each text."""
        start, end, special = self.spans(texts)
        hashes = K.span_hashes(K.prefix_hashes(texts.data), start, end) if len(start) else np.zeros(0, np.uint64)
        tokens = np.ones(len(start), np.int64)
        plain = ~special
        if plain.any():
            tokens[plain] = self._counts_of(texts.data, start[plain], end[plain], hashes[plain])
        total = np.concatenate(([0], np.cumsum(tokens)))
        return np.diff(total[np.searchsorted(start, texts.bounds)])


def _stand_ins() -> list[str]:
    """The characters that stand for the 256 bytes in vocabulary files: printable ones for themselves, the rest from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code point that begins at each lead byte; damaged bytes at the end of the buffer read as zeros."""
    out = data[lead].astype(np.int64)
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        at, first = lead[wide], out[wide]
        tail = [(padded[at + i] & 0x3F).astype(np.int64) for i in (1, 2, 3)]
        two = (first & 0x1F) << 6 | tail[0]
        three = (first & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        out[wide] = np.minimum(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)), 0x10FFFF)
    return out


def _from_the_left(hit: np.ndarray) -> np.ndarray:
    """Of hits in a row (as in "aaaa") every other one, so that no symbol is in two pairs."""
    heads = np.concatenate(([True], np.diff(hit) > 1))
    run = np.cumsum(heads) - 1
    return hit[(hit - hit[heads][run]) % 2 == 0]


_loaded: dict[str, TokenCounter] = {}


def load(path: str) -> TokenCounter:
    """The vocabulary, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens). The file must be on every node."""
    docs = K.without(docs, "n_bytes", "n_tokens", "over_limit")

    def work(batch, texts):
        yield K.added(
            batch, n_bytes=pa.array(np.diff(texts.bounds), pa.int64()), n_tokens=pa.array(load(vocabulary).count(texts), pa.int64())
        )

    counted = docs.mapInArrow(K.map_slices(text, work, SLICE_BYTES), K.schema_with(docs, "n_bytes bigint, n_tokens bigint"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
