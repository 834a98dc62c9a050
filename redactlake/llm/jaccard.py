"""N-gram Jaccard join: rare-first prefix filtering, then connected groups.

A document is the set of its distinct five-word shingles, as 64-bit hashes; equal sets are one class.
Shingles are ordered rare first, by counts of all documents' shingles kept in a sketch of fixed size
(any fixed order is right; a rare-first one is fast). Two sets that are similar enough share a shingle
among the first ``n - ceil(t * n) + 1`` of each, so only those prefixes are joined. A candidate must
also pass the length filter, the positional filter (what can still follow the shared shingle), the
suffix filter (how many hashes of each range the two sets can share) and the parity filter (an odd sketch: the
parities of 1,024 hash buckets, of which as many differ as hashes are in one set only, or fewer); each surviving pair
is verified once on the whole sets.

Within one shared shingle not all pairs are made. Groups with no more unlinked pairs than members are
joined in full. In a larger group some classes, the pivots, are compared with all others: first the least class,
which groups with the same members have in common, then four, sixteen and so on, chosen by a hash of the class. The links
found join classes into components, and what is still in different components goes to the next round. Once the
unlinked pairs that are left are at most ``PAIRS_PER_ROW`` for each row of the shared prefixes, all of them are compared.
Pairs of a round are thus linear in the rows, a group of near copies is linked after a round or two, and no link
between components can be missed. The last two filters compare the counts and parities of two sets before any set is
brought together, from the second round on where the pairs are made, in cells of bounded size; the sets a round needs are taken from the texts and kept for later rounds.

Documents with fewer words than a shingle are one shingle of all their words; null, empty and blank
texts have no shingle and are linked with nothing. Repeated rows and null ids keep rows of their own;
a group's id is its least id that is not null. An empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
SKETCH_BITS = 20
CHUNK_BITS = 14
#: Prefix shingles joined together.
RANGE_ROWS = 500_000
FLUSH_ROWS = 250_000
#: Pivots of a large group in the first round, and how many times more there are in each later one.
PIVOTS, MORE_PIVOTS = 1, 4
#: Unlinked pairs for each row of the shared prefixes that are few enough to be compared at once.
PAIRS_PER_ROW = 100
#: A group is joined in full while its unlinked pairs are at most this many times its members.
FULL_FACTOR = 1
#: Classes of a large group in one block, rows in one bucket of cells, the least number of buckets, and pairs held at once.
BLOCK, BUCKET_ROWS, LEAST_BUCKETS, PAIRS_AT_ONCE = 512, 8192, 512, 1 << 16
#: Hash ranges of the suffix filter.
SUFFIX_RANGES = 16
#: Words of 64 bits in the parities of a set.
PARITY_WORDS = 16


def shingle_sets(texts: K.Texts) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    low = texts.lower()
    words = K.words_of(low, K.SPACES)
    hashes = K.word_hashes(low, words)
    grams, bounds = K.gram_hashes(hashes, words.first, SHINGLE)
    sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    counts = words.counts()
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = hashes[words.first[i] : words.first[i + 1]]
        whole, _ = K.gram_hashes(own, np.array([0, len(own)]), len(own))
        sets[i] = K.mix(whole + np.uint64(len(own)))
    return sets


def class_of(shingles: np.ndarray) -> int:
    """One number for a set, whatever its order; as a signed 64-bit integer."""
    total = K.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(K.mix(np.array([total]))[0].astype(np.int64))


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- first pass: classes, and the sketch of shingle counts ------------------------------


def _chunk_rows(sketch: np.ndarray):
    """A sketch as one row per chunk, with a group number so that sums are made in two bounded steps."""
    width = 1 << CHUNK_BITS
    part = TaskContext.get().partitionId() // 256
    for c in range(len(sketch) // width):
        piece = sketch[c * width : (c + 1) * width]
        if piece.any():
            yield c, part, piece.astype("<u4").tobytes()


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, class, ranges, parities) rows, class null if there is none, and sketch rows (chunk, part, counts).

    ``ranges`` counts the shingles in each of the ``SUFFIX_RANGES`` hash ranges, ``parities`` tells of which hash buckets a set
    holds an odd number.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        kind_of = None
        for batch in batches:
            kind_of = batch.schema.types[0]
            for piece in K.slices(batch, "x"):
                sets = shingle_sets(K.texts_of(piece.column(1)))
                if sets:
                    flat = np.concatenate(sets)
                    sketch += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([range_counts(s) for s in sets], pa.list_(pa.int32())),
                        pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    ["key", "n_shingles", "class", "ranges", "parities", "chunk", "part", "counts"],
                )
        rows = list(_chunk_rows(sketch))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(rows), kind_of),
                    pa.nulls(len(rows), pa.int64()),
                    pa.nulls(len(rows), pa.int64()),
                    pa.nulls(len(rows), pa.list_(pa.int32())),
                    pa.nulls(len(rows), pa.list_(pa.int64())),
                    *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))),
                ],
                ["key", "n_shingles", "class", "ranges", "parities", "chunk", "part", "counts"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("x"))
    return rows.mapInArrow(
        run, f"key {kind}, n_shingles bigint, class bigint, ranges array<int>, parities array<bigint>, chunk int, part int, counts binary"
    )


def _sum_chunks(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << CHUNK_BITS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), "<u4")
    clipped = np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()
    return pa.table(
        {"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([clipped], pa.binary())}
    )


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The summed sketch: 4 MB, however many documents there are."""
    schema = "chunk int, part int, counts binary"
    chunks = rows.filter("chunk is not null").select("chunk", "part", "counts")
    summed = chunks.groupBy("chunk", "part").applyInArrow(_sum_chunks, schema).groupBy("chunk").applyInArrow(_sum_chunks, schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in summed.collect():
        out[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["counts"], "<u4")
    return out


# --- second pass: prefixes -----------------------------------------------------------------


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def rare_first(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The prefix of a set: rarest first, ties by hash."""
    order = np.argsort(sketch[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return shingles[order[: prefix_length(len(shingles))]]


def prefixes(docs: DataFrame, text: str, sketch: np.ndarray, bits: int) -> DataFrame:
    """Prefix shingles packed by hash range: (range, tokens, classes, sizes, places)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    kinds = {"tokens": "<u8", "classes": "<i8", "sizes": "<i4", "places": "<i4"}

    def run(batches):
        counts = shared.value
        held: list[tuple] = []
        size, seen = 0, set()

        def flush():
            token, cls, n, place = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.argsort(token, kind="stable")
            columns = [x[order].astype(t) for x, t in zip((token, cls, n, place), kinds.values(), strict=True)]
            edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            cuts = np.append(np.searchsorted(columns[0], edges), len(token))
            spans = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r for r, _, _ in spans], pa.int32()),
                    *(pa.array([x[a:b].tobytes() for _, a, b in spans], pa.binary()) for x in columns),
                ],
                ["range", *kinds],
            )

        for batch in batches:
            for piece in K.slices(batch, "x"):
                for s in shingle_sets(K.texts_of(piece.column(0))):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    if len(seen) < FLUSH_ROWS:  # only spares work: copies are dropped again where shingles meet
                        seen.add(c)
                    p = rare_first(s, counts)
                    held.append((p, np.full(len(p), c), np.full(len(p), len(s)), np.arange(len(p))))
                    size += len(p)
                if size >= FLUSH_ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col(text).alias("x")).mapInArrow(
        run, "range int, tokens binary, classes binary, sizes binary, places binary"
    )


def shared_prefixes(packed: DataFrame) -> DataFrame:
    """(token, class, size, place, n, first) of the prefix shingles that ``n`` > 1 classes have, ``first`` the least."""

    def keep(table: pa.Table) -> pa.Table:
        token, cls, size, place = (
            np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
            for c, t in (("tokens", "<u8"), ("classes", "<i8"), ("sizes", "<i4"), ("places", "<i4"))
        )
        order = np.lexsort((cls, token))
        token, cls, size, place = token[order], cls[order], size[order], place[order]
        once = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
        token, cls, size, place = token[once], cls[once], size[once], place[once]
        heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        n = np.repeat(sizes := np.diff(np.append(heads, len(token))), sizes)
        many = n > 1
        return pa.table(
            {
                "token": token[many].astype(np.int64),
                "class": cls[many],
                "size": size[many],
                "place": place[many],
                "n": n[many],
                "first": np.repeat(cls[heads], sizes)[many],
            }
        )

    return packed.groupBy("range").applyInArrow(keep, "token bigint, class bigint, size int, place int, n bigint, first bigint")


# --- candidates --------------------------------------------------------------------------------


def _least_overlap(a: str, b: str) -> Column:
    """The smallest intersection of two sets of these sizes that is similar enough."""
    return F.ceil(NUMERATOR * (F.col(a) + F.col(b)).cast("bigint") / F.lit(NUMERATOR + DENOMINATOR))


def in_groups(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(token, class, size, place, component, n, first, unlinked): the rows of groups that are not all of one component.

    ``unlinked`` counts the pairs of different components in the row's group.
    """
    n = F.col("n")
    if labels is None:  # every class is a component, and its groups have been counted
        return shared.withColumn("component", F.col("class")).withColumn("unlinked", n * (n - 1) / 2)
    here = shared.drop("n", "first").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    parts = here.groupBy("token", "component").agg(F.count("*").alias("n"), F.min("class").alias("first"))
    groups = parts.groupBy("token").agg(F.sum("n").alias("n"), F.sum(n * n).alias("squares"), F.min("first").alias("first"))
    groups = groups.filter("squares < n * n").select("token", "n", "first", ((n * n - F.col("squares")) / 2).alias("unlinked"))
    return here.join(groups, "token")


def next_candidates(rows: DataFrame, number: int, pivots: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare now, and the rows of large groups that remain without their pivots.

    ``rows`` are those of ``in_groups``. A large group has about ``pivots`` pivots; with ``last``, no group is large. Where rows
    have the ``ranges`` and ``parities`` of their class, the filters on these are applied to the pairs as they are made; only rows
    of large groups take their parities along, as the pairs of others are linear in the rows.
    """
    chance = F.pmod(F.xxhash64("class", F.lit(number)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("full", F.lit(last) | (F.col("unlinked") <= FULL_FACTOR * F.col("n")))
    rows = rows.withColumn("pivot", (F.col("class") == F.col("first")) | (chance < (pivots - 1) / F.col("n")))
    if "parities" in rows.columns:
        rows = rows.withColumn("parities", F.when(F.col("unlinked") > FULL_FACTOR * F.col("n"), F.col("parities")))
        pairs = pairs_in_cells(rows)
    else:
        names = ["class", "size", "place", "component"]
        left = rows.filter(F.col("full") | F.col("pivot")).select("token", *[F.col(c).alias(f"a_{c}") for c in names])
        right = rows.select("token", "full", "pivot", *[F.col(c).alias(f"b_{c}") for c in names])
        rest = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
        pairs = left.join(right, "token").filter(
            (F.col("a_component") != F.col("b_component"))
            & ((~F.col("full") & ~F.col("pivot")) | (F.col("a_class") < F.col("b_class")))
            # The length filter.
            & (DENOMINATOR * F.least("a_size", "b_size") >= NUMERATOR * F.greatest("a_size", "b_size"))
            # The positional filter, for the case that this is the first shingle shared.
            & (rest >= _least_overlap("a_size", "b_size"))
        )
        pairs = pairs.select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))
    remaining = rows.filter(~F.col("full") & ~F.col("pivot")).select("token", "class", "size", "place", "n", "first")
    return pairs.distinct(), remaining


def pairs_in_cells(rows: DataFrame) -> DataFrame:
    """(a, b), with repeats, of the pairs to compare that pass all filters; ``rows`` as in ``next_candidates``.

    A group's classes are dealt into blocks of about ``BLOCK``. Where all are compared, each two blocks meet in a cell of their own;
    where pivots are, each block meets them in its own cell. So no cell is large, and rows are sent once for each other block at most.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class", F.lit("block")), blocks).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = (
        F.when(F.col("full"), F.transform(every, lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j"))))
        .when(F.col("pivot"), F.transform(every, lambda x: F.struct(x.alias("i"), x.alias("j"))))
        .otherwise(F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j"))))
    )
    copies = F.when(F.col("full") | F.col("pivot"), F.col("blocks")).otherwise(1)
    total = rows.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    number = max(LEAST_BUCKETS, math.ceil(total / BUCKET_ROWS))
    names = ["token", "class", "size", "place", "component", "block", "full", "pivot", "ranges", "parities"]
    dealt = rows.select(*names, F.explode(cells).alias("cell")).select(*names, "cell.i", "cell.j")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(number)))
    return dealt.groupBy("bucket").applyInArrow(_pairs_of_cells, "a bigint, b bigint")


def _words(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """The lists of a column as rows of a matrix; nulls are zeros."""
    out = np.zeros((len(column), width), kind)
    out[column.is_valid().to_numpy()] = np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy() for x in column.chunks)]).reshape(-1, width)
    return out


def _pairs_of_cells(table: pa.Table) -> pa.Table:
    table = table.sort_by([(c, "ascending") for c in ("token", "i", "j", "class")])
    token, i, j, cls, size, place, component, block, full, pivot = (
        table.column(c).to_numpy() for c in ("token", "i", "j", "class", "size", "place", "component", "block", "full", "pivot")
    )
    size = size.astype(np.int64)
    ranges, odd = _words(table.column("ranges"), SUFFIX_RANGES, np.int32), _words(table.column("parities"), PARITY_WORDS, np.int64).view(np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    sizes = np.diff(np.append(heads, len(token)))
    partners = np.repeat(heads + sizes, sizes) - np.arange(len(token)) - 1  # the rows after a row in its cell
    upto = np.concatenate(([0], np.cumsum(partners)))
    found, at = [np.zeros((2, 0), np.int64)], 0
    while at < len(token):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS_AT_ONCE, "right")) - 1)
        a = np.repeat(np.arange(at, to), partners[at:to])
        b = a + 1 + np.arange(len(a)) - (upto[a] - upto[at])
        at = to
        for passes in (
            lambda a, b: component[a] != component[b],
            lambda a, b: np.where(full[a], (i[a] == j[a]) | (block[a] != block[b]), pivot[a] | pivot[b]),
            # The length filter.
            lambda a, b: DENOMINATOR * np.minimum(size[a], size[b]) >= NUMERATOR * np.maximum(size[a], size[b]),
            # The positional filter, for the case that this is the first shingle shared.
            lambda a, b: np.minimum(size[a] - place[a], size[b] - place[b]) >= -(-NUMERATOR * (size[a] + size[b]) // (NUMERATOR + DENOMINATOR)),
            # The parity filter and the suffix filter.
            lambda a, b: (NUMERATOR + DENOMINATOR) * np.bitwise_count(odd[a] ^ odd[b]).sum(1, np.int64) <= (DENOMINATOR - NUMERATOR) * (size[a] + size[b]),
            lambda a, b: (NUMERATOR + DENOMINATOR) * np.minimum(ranges[a], ranges[b]).sum(1, np.int64) >= NUMERATOR * (size[a] + size[b]),
        ):
            kept = passes(a, b)
            a, b = a[kept], b[kept]
        found.append(np.unique(np.stack((cls[a], cls[b])), axis=1))
    pairs = np.concatenate(found, axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


# --- verification ----------------------------------------------------------------------------------


def sets_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the wanted classes; a bitmap of fixed size keeps most others from being sent."""

    def mark(batches):
        bits = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            c = batch.column(0).to_numpy().view(np.uint64)
            bits[(c >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] = 1
        rows = list(_chunk_rows(bits))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                ["chunk", "part", "counts"],
            )

    marked = sketch_of(wanted.select("class").mapInArrow(mark, "chunk int, part int, counts binary")) > 0
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        sent: set[int] = set()
        for batch in batches:
            for piece in K.slices(batch, "x"):
                classes, values = [], []
                for s in shingle_sets(K.texts_of(piece.column(0))):
                    if len(s) and bits[((c := class_of(s)) & 0xFFFFFFFFFFFFFFFF) >> (64 - SKETCH_BITS)] and c not in sent:
                        if len(sent) < FLUSH_ROWS:
                            sent.add(c)
                        classes.append(c)
                        values.append(s.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(values, pa.binary())], ["class", "shingles"])

    found = docs.select(F.col(text).alias("x")).mapInArrow(run, "class bigint, shingles binary")
    return found.dropDuplicates(["class"]).join(wanted, "class", "left_semi")


def range_counts(shingles: np.ndarray) -> np.ndarray:
    """How many of an ascending set lie in each hash range."""
    edges = np.arange(1, SUFFIX_RANGES, dtype=np.uint64) * np.uint64((1 << 64) // SUFFIX_RANGES)
    return np.diff(np.concatenate(([0], np.searchsorted(shingles, edges), [len(shingles)]))).astype(np.int32)


def suffix_condition() -> Column:
    """Whether sets with ``a_ranges`` and ``b_ranges`` can share enough."""
    total = "aggregate({}, 0L, (s, x) -> s + x)"
    both = total.format("zip_with(a_ranges, b_ranges, (x, y) -> least(x, y))")
    sizes = f"({total.format('a_ranges')} + {total.format('b_ranges')})"
    return F.expr(f"{NUMERATOR + DENOMINATOR} * {both} >= {NUMERATOR} * {sizes}")


def parities(shingles: np.ndarray) -> np.ndarray:
    """One bit per hash bucket: whether a set holds an odd number of the bucket's hashes."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def parity_condition() -> Column:
    """Whether sets with ``a_parities`` and ``b_parities`` differ little enough.

    Where the parities of a bucket differ, at least one hash is in one set only.
    """
    differ = " + ".join(f"bit_count(a_parities[{i}] ^ b_parities[{i}])" for i in range(PARITY_WORDS))
    return F.expr(f"{NUMERATOR + DENOMINATOR} * ({differ}) <= {DENOMINATOR - NUMERATOR} * (cast(a_size as bigint) + b_size)")


def pairs_with(pairs: DataFrame, known: DataFrame, condition: Column) -> DataFrame:
    """The pairs that meet a condition on the columns of ``known`` (class, ...), named ``a_...`` and ``b_...``."""
    columns = [c for c in known.columns if c != "class"]
    sides = [known.select(F.col("class").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns]) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(condition).select("a", "b")


def suffix_filter(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pairs whose sets can share enough, by how many shingles each has in every hash range."""
    return pairs_with(pairs, ranges, suffix_condition())


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) that are similar enough."""

    def run(batches):
        for batch in batches:
            good = [
                similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


# --- components ------------------------------------------------------------------------------------


def components(links: DataFrame, folder: str) -> DataFrame:
    """(class, component) of all classes with a link: the least class reachable.

    Each round takes the least label among neighbours, then the label's own label, so long chains
    are halved; it ends when nothing changes.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels = _store(
        both.groupBy(F.col("u").alias("class")).agg(F.min("v").alias("v")).select("class", F.least("class", "v").alias("component")),
        f"{folder}/labels-0",
    )
    number = 0
    while True:
        number += 1
        near = both.join(labels, both["v"] == labels["class"]).groupBy(F.col("u").alias("class")).agg(F.min("component").alias("near"))
        # A label is itself a class with a label, and stepping to it can only go down.
        jump = labels.select(F.col("class").alias("component"), F.col("component").alias("jump"))
        after = (
            labels.join(near, "class", "left")
            .join(jump, "component", "left")
            .select("class", F.least("component", "near", "jump").alias("component"), F.col("component").alias("before"))
        )
        after = _store(after, f"{folder}/labels-{number}")
        labels = after.select("class", "component")
        if after.filter("component != before").isEmpty():
            return labels


def merge_labels(labels: DataFrame | None, links: DataFrame, folder: str) -> DataFrame:
    """``labels`` (class, component) after more links: components that a link joins become one."""
    if labels is None:
        return components(links, folder)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    known = ends.join(labels, "class", "left_anti").select("class", F.col("class").alias("component")).unionByName(labels)
    known = _store(known, f"{folder}/known")
    sides = [known.select(F.col("class").alias(c), F.col("component").alias(f"{c}_of")) for c in ("a", "b")]
    between = links.join(sides[0], "a").join(sides[1], "b").filter("a_of != b_of")
    between = _store(between.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).distinct(), f"{folder}/between")
    joined = components(between, folder).select(F.col("class").alias("component"), F.col("component").alias("after"))
    return _store(known.join(joined, "component", "left").select("class", F.coalesce("after", "component").alias("component")), f"{folder}/after")


def group_similar(docs: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """(key, n_shingles, class, component_id) of every row. ``folder`` (shared, new) takes intermediate tables."""
    spark = docs.sparkSession
    scanned = _store(scan(docs, key, text), f"{folder}/scan")
    rows = scanned.filter("chunk is null").select("key", "n_shingles", "class")
    total = rows.agg(F.coalesce(F.sum(F.col("n_shingles") * (DENOMINATOR - NUMERATOR) / DENOMINATOR + 1), F.lit(0))).first()[0]
    bits = max(6, math.ceil(math.log2(max(1, total / RANGE_ROWS))))
    shared = _store(shared_prefixes(prefixes(docs, text, sketch_of(scanned), bits)), f"{folder}/shared")
    labels = None
    if not shared.isEmpty():
        ranges = scanned.filter("class is not null").select("class", "ranges", "parities", F.col("n_shingles").alias("size"))
        ranges = ranges.dropDuplicates(["class"])
        ranges = _store(ranges.join(shared.select("class").distinct(), "class", "left_semi"), f"{folder}/ranges")
        few = PAIRS_PER_ROW * shared.count()
        done = sets = None
        number, pivots, last = 0, PIVOTS, False
        while not last:
            here = in_groups(shared, labels)
            if number:
                here = _store(here, f"{folder}/groups-{number}")
                unlinked = here.agg(F.sum(F.col("unlinked") / F.col("n"))).first()[0]
                if not unlinked:
                    break
                last = unlinked <= few
                here = here.join(ranges.drop("size"), "class")
            pairs, shared = next_candidates(here, number, pivots, last)
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            likely = _store(pairs if number else pairs_with(pairs, ranges, parity_condition() & suffix_condition()), f"{folder}/pairs-{number}")
            wanted = likely.select(F.explode(F.array("a", "b")).alias("class")).distinct()
            if sets is not None:
                wanted = wanted.join(sets.select("class"), "class", "left_anti")
            wanted = _store(wanted, f"{folder}/wanted-{number}")
            if sets is None or not wanted.isEmpty():
                more = _store(sets_of(docs, text, wanted), f"{folder}/sets-{number}")
                sets = more if sets is None else sets.unionByName(more)
            found = _store(verify(likely, sets), f"{folder}/links-{number}")
            if not found.isEmpty():
                labels = merge_labels(labels, found, f"{folder}/components-{number}")
            elif labels is None:
                labels = spark.createDataFrame([], "class bigint, component bigint")
            done = likely if done is None else done.unionByName(likely)
            number, pivots = number + 1, pivots * MORE_PIVOTS
    if labels is None:
        labels = spark.createDataFrame([], "class bigint, component bigint")
    joined = rows.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = joined.filter("component is not null").groupBy("component").agg(F.min("key").alias("least"))
    return joined.join(ids, "component", "left").select(
        F.col("key").alias(key), "n_shingles", "class", F.coalesce("least", "key").alias("component_id")
    )
