"""Arrow/NumPy column functions for the steps Spark's built-ins cannot do in linear time.

``screen`` finds where surfaces may start, ``leftmost_longest`` resolves overlaps and
``lookup_surfaces`` reads a small inventory. Each works on one Arrow batch of a column;
partitioning, joins, grouping and text assembly stay with Spark.

The screen is a k-gram pre-filter. A surface of L bytes belongs to the tier k = largest power
of two <= L. Two fingerprints of it are set in one filter: of its first k bytes and of all of
its bytes. Over a text, a prefix sum of mixed bytes gives the fingerprint of any window in
O(1), so a batch is tested with a few array operations per tier; positions that pass are
tested again at each exact length of the tier. UTF-8 is self-synchronising, so byte equality
is character equality.

Two filters serve it. A small inventory has a bitmap with one flag per fingerprint. A large one has
a split-block filter that grows with it: a fingerprint chooses one word of 64 bits and sets a bit
in each of its four lanes, and the words come in slices of bounded size.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 1 << 16
SLICE_BYTES = 1 << 18  # of text that a kernel holds arrays of its own for at a time
MAX_FLAG_BITS = 22  # up to here the bitmap is unpacked to one byte per flag, 4 MiB at most
MATCH_TYPE = (
    "array<struct<start:int,end:int,surface:string,item_id:bigint,"
    "code:string,desc:string,variant:string,alias_id:bigint>>"
)
CANDIDATE_TYPE = "array<struct<start:int,end:int,surface:string>>"
SEGMENT_TYPE = "array<struct<seg_no:int,seg_start:int,chunk:string,redactable:boolean>>"
PLACE_TYPE = "array<struct<seg_no:int,seg_start:int>>"


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _powers(n: int):
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, _u64(base)), np.full(n, _u64(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed_bytes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _u64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(29)
    x *= _u64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slot(fingerprint, length, bits: int):
    """Bitmap position of fingerprints of one length, or of one length each."""
    factor = 0x2545F4914F6CDD1D
    key = length * _u64(factor) if isinstance(length, np.ndarray) else _u64(length * factor)
    return ((fingerprint ^ key) * _u64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)


#: A split-block filter: bits of a lane's number in a word, words per slice (16 MiB), words per fingerprint.
LANES, LANE_BITS = 4, 16
SLICE_WORDS = 1 << 21
WORDS_PER_FINGERPRINT = 0.5


def _mixed(fingerprint, length):
    """64 mixed bits of fingerprints of one length, or of one length each; the same as behind ``_slot``."""
    return _slot(fingerprint, length, 64)


def _lanes(mixed: np.ndarray):
    """The bit that each lane of the word has for these fingerprints."""
    more = (mixed ^ (mixed >> np.uint64(31))) * _u64(0xD6E8FEB86659FD93)
    return [(more >> np.uint64(60 - 4 * lane)) & np.uint64(LANE_BITS - 1) for lane in range(LANES)]


def _word_of(mixed: np.ndarray, word_bits: int) -> np.ndarray:
    return (mixed >> np.uint64(64 - word_bits)).astype(np.int64)


def _tier(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _utf8(arr: pa.Array):
    """Bytes of a string array and the bounds of each row in them; nulls are empty rows."""
    wide = arr.type == pa.large_string()
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    if data is None or len(arr) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(arr: pa.Array, max_bytes: int = SLICE_BYTES):
    """(first row, rows) of runs of about ``max_bytes`` of text; a longer text is a run of its own."""
    _, bounds = _utf8(arr)
    at = 0
    while at < len(arr):
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + max_bytes, "right")) - 1)
        yield at, upto - at
        at = upto


def by_slices(kernel):
    """A kernel over a column of texts, and columns beside it, applied to a slice of the batch at a time."""

    def run(arr: pa.Array, *others: pa.Array) -> pa.Array:
        parts = [kernel(*(a.slice(at, n) for a in (arr, *others))) for at, n in slices(arr)]
        return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else kernel(arr, *others)

    return run


def surface_slots(arr: pa.Array, bits: int):
    """Bitmap positions of the prefix and of the whole of each (non-empty) surface; with 64 bits, all mixed bits."""
    data, bounds = _utf8(arr)
    mixed = _mixed_bytes()
    size = np.diff(bounds)
    tier = np.int64(1) << (np.frexp(size)[1].astype(np.int64) - 1)
    prefix, full = np.zeros(len(arr), np.uint64), np.zeros(len(arr), np.uint64)
    row = 0
    while row < len(arr):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + WINDOW, side="right")) - 1)
        part = data[bounds[row] : bounds[stop]]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[part] * up[:-1])])
        at, n, k = bounds[row:stop] - bounds[row], size[row:stop], tier[row:stop]
        for out, length in ((prefix, k), (full, n)):
            value = (sums[at + length] - sums[at]) * down[at]
            out[row:stop] = _slot(value, length.astype(np.uint64), bits)
        row = stop
    return prefix.view(np.int64), full.view(np.int64)


def filter_bits(arr: pa.Array, word_bits: int) -> np.ndarray:
    """Numbers of the bits that each surface sets in a split-block filter, 2 * ``LANES`` per surface."""
    out = []
    for mixed in surface_slots(arr, 64):
        mixed = mixed.view(np.uint64)
        base = _word_of(mixed, word_bits) * 64
        out += [base + LANE_BITS * lane + bit.astype(np.int64) for lane, bit in enumerate(_lanes(mixed))]
    return np.stack(out, axis=1).ravel()


def make_filter_bits(word_bits: int):
    """surface -> array of bit numbers."""

    def bits(arr: pa.Array) -> pa.Array:
        offsets = np.arange(len(arr) + 1, dtype=np.int32) * (2 * LANES)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(filter_bits(arr, word_bits), pa.int64()))

    return F.arrow_udf(bits, "array<bigint>")


def bitmap_probe(bitmap: np.ndarray, bits: int):
    """(fingerprints, length) -> which of them have their flag set."""
    flags = np.unpackbits(bitmap, bitorder="little").view(bool) if bits <= MAX_FLAG_BITS else None

    def probe(fingerprint: np.ndarray, length: int) -> np.ndarray:
        at = _slot(fingerprint, length, bits).view(np.int64)
        if flags is not None:
            return flags.take(at)
        return ((bitmap.take(at >> 3) >> (at & 7).astype(np.uint8)) & np.uint8(1)).view(bool)

    return probe


def block_probe(words: np.ndarray):
    """(fingerprints, length) -> which of them have their bits in all lanes of their word."""
    word_bits = len(words).bit_length() - 1

    def probe(fingerprint: np.ndarray, length: int) -> np.ndarray:
        mixed = _mixed(fingerprint, length)
        found = words.take(_word_of(mixed, word_bits))
        hit = np.ones(len(mixed), bool)
        left = np.arange(len(mixed))
        for lane, bit in enumerate(_lanes(mixed)):
            # Few pass the first lanes, so the later ones are asked of those only.
            here = ((found[left] >> (bit[left] + np.uint64(LANE_BITS * lane))) & np.uint64(1)).astype(bool)
            hit[left[~here]] = False
            left = left[here]
        return hit

    return probe


def _survivors(data: np.ndarray, bounds: np.ndarray, member, lengths, cache: dict):
    """(position, length) byte windows of ``data`` that pass the filter and stay inside one row."""
    longest = max(lengths)
    width = max(WINDOW, 2 * longest)
    if "up" not in cache:
        cache["up"], cache["down"] = _powers(width + longest + 1)
        cache["mixed"] = _mixed_bytes()
    up, down, mixed = cache["up"], cache["down"], cache["mixed"]
    tiers: dict[int, list[int]] = {}
    for n in sorted(lengths):
        tiers.setdefault(_tier(n), []).append(n)
    found_at, found_len = [], []
    for base in range(0, len(data), width):
        part = data[base : base + width + longest]
        n_starts = min(width, len(data) - base)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(mixed.take(part) * up[: len(part)], out=sums[1:])
        for k, exact in tiers.items():
            n = min(n_starts, len(part) - k + 1)
            if n <= 0:
                continue
            window = (sums[k : k + n] - sums[:n]) * down[:n]
            at = np.flatnonzero(member(window, k))
            if not len(at):
                continue
            room = bounds[np.searchsorted(bounds, at + base, side="right")] - base - at
            for length in exact:
                ok = at[room >= length]
                value = (sums[ok + length] - sums[ok]) * down[ok]
                ok = ok[member(value, length)] + base
                found_at.append(ok)
                found_len.append(np.full(len(ok), length, np.int64))
    at = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
    size = np.concatenate(found_len) if found_len else np.zeros(0, np.int64)
    # A window that cuts a character in half is a false alarm.
    whole = (data[at] & 0xC0) != 0x80
    end = at + size
    inside = end < len(data)
    whole[inside] &= (data[end[inside]] & 0xC0) != 0x80
    at, size = at[whole], size[whole]
    order = np.lexsort((-size, at))
    return at[order], size[order]


def _char_offsets(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, size: np.ndarray):
    """Row of each byte window and its start and end counted in characters of that row."""
    row = np.searchsorted(bounds, at, side="right") - 1
    first = bounds[row]
    start, end = at - first, at + size - first
    if len(at) and (data >= 0x80).any():
        # Characters are counted between the points of interest only.
        points = np.unique(np.concatenate([first, at, at + size]))
        points = points[points < len(data)]
        between = np.add.reduceat((data & 0xC0) != 0x80, points, dtype=np.int64)
        chars = np.concatenate([np.zeros(1, np.int64), np.cumsum(between)])
        base = chars[np.searchsorted(points, first)]
        start = chars[np.searchsorted(points, at)] - base
        end = chars[np.searchsorted(points, at + size)] - base
    return row, start, end


def _as_lists(n_rows: int, row: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    structs = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def _slice_udf(kernel, kind: str):
    """``kernel(texts)`` as a column function."""
    whole = by_slices(kernel)

    def sliced(arr: pa.Array) -> pa.Array:
        return whole(arr)

    return F.arrow_udf(sliced, kind)


def make_screen(lengths: list[int], slices: list):
    """text -> array<struct<start, end, surface>>: windows that may be surfaces (no misses).

    ``slices`` are broadcasts of the words of a split-block filter, in order.
    """
    cache: dict = {}

    def screen(arr: pa.Array) -> pa.Array:
        if "probe" not in cache:
            words = [np.frombuffer(s.value, np.uint64) for s in slices]
            cache["probe"] = block_probe(np.concatenate(words) if len(words) > 1 else words[0])
        data, bounds = _utf8(arr)
        at, size = _survivors(data, bounds, cache["probe"], lengths, cache)
        row, start, end = _char_offsets(data, bounds, at, size)
        raw = data.tobytes() if len(at) else b""
        words = [raw[a : a + n] for a, n in zip(at.tolist(), size.tolist())]
        return _as_lists(
            len(arr),
            row,
            {
                "start": pa.array(start, pa.int32()),
                "end": pa.array(end, pa.int32()),
                "surface": pa.array(words, pa.binary()).cast(pa.string()),
            },
        )

    return _slice_udf(screen, CANDIDATE_TYPE)


def make_matcher(state, select: bool = False):
    """text -> all occurrences of a small inventory, ordered by (start, longest first), or with ``select`` those kept.

    ``state`` is a broadcast of the screen plus the pattern table itself; callers use it only
    below a checked size.
    """
    cache: dict = {}

    def match(arr: pa.Array) -> pa.Array:
        s = state.value
        if "words" not in s:  # once per worker process, which keeps the broadcast value
            s["table"] = pa.ipc.open_stream(s["patterns"]).read_all().combine_chunks()
            s["words"] = {w.encode(): i for i, w in enumerate(s["table"].column("surface").to_pylist())}
        table, words = s["table"], s["words"]
        data, bounds = _utf8(arr)
        if "probe" not in cache:
            cache["probe"] = bitmap_probe(np.frombuffer(s["bitmap"], np.uint8), s["bits"])
        at, size = _survivors(data, bounds, cache["probe"], s["lengths"], cache)
        raw = data.tobytes() if len(at) else b""
        which = np.array(
            [words.get(raw[a : a + n], -1) for a, n in zip(at.tolist(), size.tolist())], np.int64
        )
        real = which >= 0
        at, size, which = at[real], size[real], which[real]
        row, start, end = _char_offsets(data, bounds, at, size)
        picked = table.take(pa.array(which))
        fields = {"start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())}
        for name in ("surface", "item_id", "code", "desc", "variant", "alias_id"):
            column = picked.column(name).combine_chunks()
            fields[name] = column.cast(pa.string()) if pa.types.is_large_string(column.type) else column
        found = _as_lists(len(arr), row, fields)
        return _leftmost_longest(found) if select else found

    return _slice_udf(match, MATCH_TYPE)


def _leftmost_longest(arr: pa.Array) -> pa.Array:
    """The greedy non-overlapping spans of each row."""
    offsets = arr.offsets.to_numpy().astype(np.int64)
    flat = arr.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    start = flat.field("start").to_numpy(zero_copy_only=False)
    end = flat.field("end").to_numpy(zero_copy_only=False)
    keep = np.ones(len(start), bool)
    clash = np.zeros(len(start), bool)
    clash[1:] = start[1:] < end[:-1]
    clash[offsets[(offsets > 0) & (offsets < len(start))]] = False
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(clash), side="right") - 1)
    for r in rows.tolist():
        a, b = int(offsets[r]), int(offsets[r + 1])
        last = -1
        for i, (s, e) in enumerate(zip(start[a:b].tolist(), end[a:b].tolist()), a):
            if s >= last:
                last = e
            else:
                keep[i] = False
    counts = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(counts), flat.filter(pa.array(keep)))


def make_leftmost_longest(element_type: str):
    """Keep, per row, the greedy non-overlapping spans of an array ordered by (start, longest first)."""

    def leftmost_longest(arr: pa.Array) -> pa.Array:
        return _leftmost_longest(arr)

    return F.arrow_udf(leftmost_longest, element_type)


def _spans_of(batch, keys: list[str], start: str, end: str):
    """(key, start, end) of the rows, keys as tuples."""
    columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in (*keys, start, end)]
    return zip(zip(*columns[:-2]) if keys else ((),) * batch.num_rows, columns[-2], columns[-1])


def _key_of(batch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(batch.schema.names.index(c))[row].as_py() for c in keys)


def _new_keys(batch, keys: list[str], before) -> np.ndarray:
    """Which rows have another key than the row before them, for the first row the key ``before`` (None: there is none)."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None or _key_of(batch, keys, 0) != before
    for c in keys:
        column = batch.column(batch.schema.names.index(c))
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            new[1:] |= [a != b for a, b in zip(values[:-1], values[1:])]
            continue
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return new


def _bounds_of(batch, start: str, end: str) -> list[np.ndarray]:
    columns = [batch.column(batch.schema.names.index(c)) for c in (start, end)]
    plain = all(pa.types.is_integer(c.type) and not c.null_count for c in columns)
    return [c.to_numpy(zero_copy_only=False) if plain else np.array([*c.to_pylist(), None], object)[:-1] for c in columns]


def _greedy(new: np.ndarray, starts: np.ndarray, ends: np.ndarray, last):
    """Which spans the greedy choice keeps, and where the last of them ends; ``last``: where the one before the first row ends.

    A row that begins where the row before it, if kept, has ended is kept as well, so only rows that do not are walked through,
    each time up to the next row that is kept.
    """
    n = len(starts)
    keep = np.ones(n, bool)
    same = np.flatnonzero(~new[1:]) + 1
    clashes = same[(starts[same] < ends[same - 1]).astype(bool)].tolist()
    if not new[0] and last is not None and starts[0] < last:
        clashes.insert(0, 0)
    if not clashes:
        return keep, ends[-1:].tolist()[0]
    fresh, begin, stop = new.tolist(), starts.tolist(), ends.tolist()
    at = 0
    for i in clashes:
        if i <= at and at:
            continue
        upto = stop[i - 1] if i else last
        at = i
        while at < n and not fresh[at] and begin[at] < upto:
            at += 1
        keep[i:at] = False
    return keep, upto if at == n else stop[-1]


def make_span_summary(keys: list[str], start: str, end: str):
    """One row per partition of spans sorted by (keys, start, longest first).

    It gives the partition's first key and where that begins, its last key, whether those are one run, how far
    the last run's spans reach, and where the greedy choice over that run ends if nothing is carried into it.
    """

    def summary(batches):
        part = TaskContext.get().partitionId()
        types, first, key = None, None, None
        reach = last = one = None
        for batch in batches:
            types = types or [batch.schema.field(c).type for c in (*keys, start, end)]
            if not batch.num_rows:
                continue
            new = _new_keys(batch, keys, key)
            starts, ends = _bounds_of(batch, start, end)
            runs = np.flatnonzero(new)
            if first is None:
                first, one = (_key_of(batch, keys, 0), starts[:1].tolist()[0]), True
                runs = runs[1:]
            one = one and not len(runs)
            at = int(runs[-1]) if len(runs) else 0  # the last run so far
            top = ends[at:].max(keepdims=True).tolist()[0]
            reach = top if reach is None or new[at] else max(reach, top)
            last = _greedy(new[at:], starts[at:], ends[at:], last)[1]
            key = _key_of(batch, keys, batch.num_rows - 1)
        if first is not None:
            row = [part, *first[0], *key, first[1], one, reach, last]
            kinds = [pa.int32(), *types[:-2], *types[:-2], types[-2], pa.bool_(), types[-1], types[-1]]
            names = ["part", *[f"f{i}" for i in range(len(keys))], *[f"l{i}" for i in range(len(keys))]]
            names += ["first_start", "one_run", "reach", "fresh"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return summary


def make_carry_table(keys: list[str], start: str, end: str, reaches):
    """(part, upto, fresh) of the partitions in ``reaches``: where the choice over the first run ends, by what is carried in.

    A choice carried in up to ``upto`` (and beyond the row before) ends at ``fresh``; one beyond the last row passes through.
    ``reaches`` is a broadcast of how far spans of earlier partitions reach into the run; rows beyond it need no entry.
    """

    def carry_table(batches):
        part = TaskContext.get().partitionId()
        if part not in reaches.value:
            return
        first, starts, ends = None, [], []
        for batch in batches:
            for k, s, e in _spans_of(batch, keys, start, end):
                first = (k,) if first is None else first
                if k != first[0]:
                    break
                starts.append(s)
                ends.append(e)
            else:
                continue
            break
        if not starts:
            return
        starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
        n = len(starts)
        follows = np.maximum(np.searchsorted(starts, ends, "left"), np.arange(1, n + 1)).tolist()
        final = ends.tolist()
        for i in range(n - 1, -1, -1):
            if follows[i] < n:
                final[i] = final[follows[i]]
        final = np.array(final)
        # Equal starts: the first row of them is entered. Neighbouring entries that end alike are one.
        entry = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1])))
        entry = entry[np.concatenate(([True], starts[entry[:-1]] < reaches.value[part]))]
        same = np.concatenate((final[entry[1:]] == final[entry[:-1]], [False]))
        entry = entry[~same]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(entry), part, np.int32)), pa.array(starts[entry]), pa.array(final[entry])],
            ["part", "upto", "fresh"],
        )

    return carry_table


def make_carry_walk(runs):
    """(part, carried) of the partitions a choice is carried into, from their carry tables in order of (part, upto).

    ``runs`` is a broadcast of the summaries, in order: (part, continues, first_start, one_run, reach, fresh).
    """

    def carry_walk(batches):
        entries = (
            (part, upto, fresh)
            for batch in batches
            for part, upto, fresh in zip(*(batch.column(i).to_pylist() for i in range(3)))
        )
        entry = next(entries, None)
        found, out = [], None
        for part, continues, first_start, one_run, _, fresh in runs.value:
            carried = out if continues else None
            if carried is not None:
                found.append((part, carried))
            out = fresh
            if one_run and carried is not None and carried > first_start:
                out = carried
                while entry is not None and entry[0] <= part:
                    if entry[0] == part and entry[1] >= carried:
                        out = entry[2]
                        break
                    entry = next(entries, None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in found], pa.int32()), pa.array([c for _, c in found], pa.int64())], ["part", "carried"]
        )

    return carry_walk


def make_greedy_scan(keys: list[str], start: str, end: str, carried):
    """Batches sorted by (keys, start, longest first) -> the greedily kept rows.

    ``carried`` is a broadcast of where the choice of earlier partitions ends, for the first key of a partition.
    Only the current key and where its last kept span ends go from batch to batch.
    """

    def scan(batches):
        last, current = carried.value.get(TaskContext.get().partitionId()), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _new_keys(batch, keys, current)
            new[0] &= current is not None  # the first run of a partition may go on from an earlier one
            keep, last = _greedy(new, *_bounds_of(batch, start, end), last)
            current = _key_of(batch, keys, batch.num_rows - 1)
            yield batch.filter(pa.array(keep))

    return scan


def _fences(data: np.ndarray, bounds: np.ndarray):
    """(begin, end) of the fenced ranges in the bytes of all rows, ascending.

    A range begins at a line that starts with three backticks and ends with the next line that is nothing else.
    """
    none = np.zeros(0, np.int64)
    if len(data) < 6:
        return none, none
    tick = data == 0x60
    at = np.flatnonzero(tick[:-2] & tick[1:-1] & tick[2:])
    row = np.searchsorted(bounds, at, side="right") - 1
    opens = (at == bounds[row]) | (data[at - 1] == 10)
    opens &= at + 3 <= bounds[row + 1]
    at, row = at[opens], row[opens]
    if len(at) < 2:
        return none, none
    behind = at + 3
    closes = (behind == bounds[row + 1]) | (data[np.minimum(behind, len(data) - 1)] == 10)
    # The next closing line of the same row, for every line that may open.
    place = np.arange(len(at))
    upto = np.minimum.accumulate(np.where(closes, place, len(at))[::-1])[::-1]
    later = np.append(upto[1:], len(at))
    inside = later < len(at)
    inside[inside] = row[later[inside]] == row[inside]
    begin, end = [], []
    i, later, inside, rows = 0, later.tolist(), inside.tolist(), np.searchsorted(row, row, side="right").tolist()
    while i < len(later):
        if inside[i]:
            begin.append(i)
            end.append(later[i])
            i = later[i] + 1
        else:  # nor can any later line of this row
            i = rows[i]
    return at[begin], at[end] + 3


def _cuts(data: np.ndarray, bounds: np.ndarray):
    """Segments of all rows: first byte, row, number in the row, first character in the row, whether fenced."""
    begin, end = _fences(data, bounds)
    starts = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], begin, end]))
    starts = starts[starts < len(data)].astype(np.int64)
    row = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(row, row)
    chars = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        np.cumsum(np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64), out=chars[1:])
    fenced = np.zeros(len(starts), bool)
    fenced[np.searchsorted(starts, begin)] = True
    return starts, row, np.arange(len(starts)) - first, chars[:-1] - chars[first], fenced


def make_segmenter():
    """text -> its segments, cut at fences; a null text has a null list. The chunks share the batch's bytes."""

    def segment(arr: pa.Array) -> pa.Array:
        data, bounds = _utf8(arr)
        starts, row, number, first_char, fenced = _cuts(data, bounds)
        wide = len(data) > np.iinfo(np.int32).max
        offsets = np.append(starts, len(data)).astype(np.int64 if wide else np.int32)
        kind = pa.large_string() if wide else pa.string()
        chunks = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        found = _as_lists(
            len(arr),
            row,
            {
                "seg_no": pa.array(number, pa.int32()),
                "seg_start": pa.array(first_char, pa.int32()),
                "chunk": chunks,
                "redactable": pa.array(~fenced),
            },
        )
        if not arr.null_count:
            return found
        return pa.ListArray.from_arrays(found.offsets, found.values, mask=arr.is_null())

    return F.arrow_udf(segment, SEGMENT_TYPE)


def make_locator():
    """(text, ascending character positions) -> the segment each lies in."""

    @by_slices
    def place(arr: pa.Array, positions: pa.Array) -> pa.Array:
        data, bounds = _utf8(arr)
        _, row, number, first_char, _ = _cuts(data, bounds)
        counts = positions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        spot = positions.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.repeat(np.arange(len(arr)), counts)
        # Rows and characters as one ascending number.
        width = int(max(spot.max(initial=0), first_char.max(initial=0))) + 1
        at = np.searchsorted(row * width + first_char, own * width + spot, side="right") - 1
        return _as_lists(
            len(arr), own, {"seg_no": pa.array(number[at], pa.int32()), "seg_start": pa.array(first_char[at], pa.int32())}
        )

    def locate(arr: pa.Array, positions: pa.Array) -> pa.Array:
        return place(arr, positions)

    return F.arrow_udf(locate, PLACE_TYPE)


def make_lookup(state):
    """array of (item_id, alias_id) keys -> array of surfaces from a small inventory.

    A missing alias falls back to the item's own surface; a missing item gives null.
    """

    def lookup(items: pa.Array, aliases: pa.Array) -> pa.Array:
        s = state.value
        if "known" not in s:
            table = pa.ipc.open_stream(s["surfaces"]).read_all()
            columns = [table.column(c).to_pylist() for c in ("item_id", "alias_id", "surface")]
            s["known"] = {(i, a): surface for i, a, surface in zip(*columns)}
        known = s["known"]
        offsets = items.offsets.to_numpy().astype(np.int64)
        first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        pairs = zip(items.values.slice(first, n).to_pylist(), aliases.flatten().to_pylist())
        found = [known.get((i, a), known.get((i, None))) for i, a in pairs]
        return pa.ListArray.from_arrays(pa.array((offsets - first).astype(np.int32)), pa.array(found, pa.string()))

    return F.arrow_udf(lookup, "array<string>")
