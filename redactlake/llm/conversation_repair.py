"""Conversation structure repair by an auction shortest-path algorithm over a lattice of edits.

A conversation's rows, by turn, are the layers of a lattice; its nodes are (rows done, state), the states
being: nothing said, system said, user said, assistant said. Arcs are edits with integer costs. Keep and Rerole
say a row with its own or the role that may come next, Delete drops it, Insert says an empty text in between
without taking a row. Every path from the first node to the sink (nothing or assistant said, no row left)
leaves a conversation of the form ``(s?(ua)+)?``; the cheapest one is the repair.

*Auction.* Every node has a price, at first zero, that is never above the cost of an arc plus the price at its end.
From an origin a path grows: where its last node's price equals the least such sum, it is extended over that arc;
where the price is lower, it is raised to the sum and the path is contracted by that node. It ends in a node that is
settled, which settles all nodes of the path: their prices are exact. Origins are taken from the last layer
to the first, so a path seldom leaves its layer. At the end an arc lies on a cheapest path exactly where it is *tight*
(price = cost + price at its end), so the least audit string is read off from the front, by the first letter of
the tight arcs of each node.

*Any length.* Prices of a layer less their minimum take few values, so a layer is a map between their numbers, fixed by
the kind of its row. Chunks of at most ``CHUNK`` rows are reduced to such maps in parallel, the maps of a
conversation are applied from its end, and each chunk then gets the prices behind each of its rows. Only the
last pass, which follows the tight arcs and feeds one SHA-256, goes through a conversation's rows in order; it is a
stream and holds the edits alone, which are one value of the result. No pass gathers a conversation.

Null roles and texts are one space, as are null ids and turns in the damage key; null turns come first, a null id is a
conversation like others. Rows of one turn are taken by role, then by text. Repeated rows count as
duplicates. Of a conversation without rows all numbers are zero, the audit is empty and the hash is that of no bytes. An
empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and what a kept or reroled row costs more if it is truncated.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: The faults of a row, in order of precedence.
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
LEGAL_PAIRS = ("su", "ua", "au")

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
SINK = 2 * STATES
#: What may be said next, and the state behind it, whatever the row's own role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SAYS = {USER: "user", ASSISTANT: "assistant"}
#: Initials that can be kept, the others being one class.
INITIALS = "sua"
CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS
END = -1


# --- the lattice, one layer at a time ------------------------------------------------------


def kind_of(initial: int, fault: int) -> int:
    """What a layer's arcs depend on: the class of the row's initial (3: none of ``INITIALS``) and its fault."""
    return initial * 4 + fault


def arcs_of(kind: int) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, node) of the arcs that leave each state; nodes 0-3 are this layer's, 4-7 the next one's."""
    out = []
    for state in range(STATES):
        arcs = [("I", INSERT, NEXT[state])]
        if kind == END:
            if state in (START, ASSISTANT):
                arcs.append(("", 0, SINK))
        else:
            initial, fault = divmod(kind, 4)
            arcs.append(("D", DELETE, STATES + state))
            if fault not in (BLANK, DUPLICATE):
                more = CUT_OFF if fault == TRUNCATED else 0
                arcs.append(("R", REROLE + more, STATES + NEXT[state]))
                said = {0: SYSTEM, 1: USER, 2: ASSISTANT}.get(initial)
                if said == NEXT[state] or (said == SYSTEM and state == START):
                    arcs.append(("K", KEEP + more, STATES + said))
        out.append(arcs)
    return out


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], settled: set[int], origin: int) -> None:
    """Raise ``price`` until a path of tight arcs leads from ``origin`` to a settled node; then its nodes are settled."""
    path = [origin]
    while path[-1] not in settled:
        here = path[-1]
        least, step = min((cost + price[to], to) for _, cost, to in arcs[here])
        if price[here] < least:
            price[here] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(step)
    settled.update(path)


@lru_cache(maxsize=None)
def layer(kind: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """The prices of a layer less their minimum, and each state's first edits on the least of its cheapest paths.

    ``behind`` are the prices of the next layer; of the end, nothing. Edits lead to (or end in) a state of the next layer.
    """
    price = [0] * STATES + list(behind or [0] * STATES) + [0]
    settled = {SINK} if kind == END else set(range(STATES, 2 * STATES))
    arcs = arcs_of(kind)
    for state in range(STATES):
        auction(arcs, price, settled, state)
    moves = []
    for state in range(STATES):
        letters, node = "", state
        while node < STATES:
            letter, _, node = min(a for a in arcs[node] if price[node] == a[1] + price[a[2]])
            letters += letter
        moves.append((letters, END if node == SINK else node - STATES))
    low = min(price[:STATES])
    return tuple(p - low for p in price[:STATES]), tuple(moves)


@lru_cache(maxsize=None)
def price_numbers() -> tuple[list[tuple[int, ...]], dict[tuple[int, ...], int]]:
    """All prices (less their minimum) that a layer can have, numbered; number 0 is those of the end."""
    found = [layer(END, ())[0]]
    number = {found[0]: 0}
    for prices in found:  # grows meanwhile
        for kind in range(4 * (len(INITIALS) + 1)):
            before = layer(kind, prices)[0]
            if before not in number:
                number[before] = len(found)
                found.append(before)
    return found, number


@lru_cache(maxsize=None)
def before(kind: int, behind: int) -> int:
    """The number of a layer's prices from its kind and the number of those behind it."""
    found, number = price_numbers()
    return number[layer(kind, found[behind])[0]]


def moves_of(kind: int, behind: int) -> tuple[tuple[str, int], ...]:
    return layer(kind, () if kind == END else price_numbers()[0][behind])[1]


# --- rows --------------------------------------------------------------------------------------


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults that depend on the ids alone."""
    space = F.lit(" ")
    number = F.crc32(
        F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")
    ) % 20
    rows = conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        number.alias("number"),
    ).filter("number != 0")
    changed = F.when(F.col("number") == 1, "").when(F.col("number") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("number") == 3, 2).otherwise(1))
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("number") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``seq``, ascending by conversation, turn, role and text. A large conversation lies in many tasks."""
    ranged = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32))
    return ranged.sortWithinPartitions("conv", "turn", "role", "text").withColumn("seq", F.monotonically_increasing_id())


def marks(rows: DataFrame) -> DataFrame:
    """(conv, seq, chunk, fault, kind) of every row.

    A row repeats an earlier one if its conversation, role and text (by 128-bit digest) have a lesser ``seq``; the least is found
    by a plain aggregate, and only what occurs more than once is joined.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    name = F.col("conv").cast("string")
    key = F.md5(
        F.concat(F.coalesce(F.length(name), F.lit(-1)), F.lit(":"), F.coalesce(name, F.lit("")), F.length("role"), F.lit(":"), "role", "text").cast("binary")
    )
    seen = rows.select("conv", "seq", "role", key.alias("key"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).alias("last"))
    repeated = seen.filter(~F.col("blank")).groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("seq") > F.col("first"), DUPLICATE)
        .when(~F.col("last").isin(*STOPS), TRUNCATED)
        .otherwise(SOUND)
    )
    initial = F.substring("role", 1, 1)
    group = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(len(INITIALS))
    joined = seen.join(repeated.select("key", "first"), "key", "left")
    return joined.select("conv", "seq", F.shiftright("seq", CHUNK_BITS).alias("chunk"), fault.alias("fault"), (group * 4 + fault).alias("kind"))


# --- passes --------------------------------------------------------------------------------------


def _stream(rows: DataFrame, run, columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``run``, from an iterator of row tuples to one of result tuples, over each partition as it is sorted.

    ``columns`` gives names, SQL types and Arrow types of the result; ``conv`` has the type it has in ``rows``.
    """
    own = rows.schema["conv"].dataType.simpleString() if "conv" in rows.columns else None
    schema = ", ".join(f"{name} {own if name == 'conv' else kind}" for name, (kind, _) in columns.items())

    def work(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field("conv").type if name == "conv" else kind for name, (_, kind) in columns.items()]
        tuples = (t for b in chain([first], batches) for t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = run(tuples)
        while held := list(islice(found, 4096)):
            arrays = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, list(columns))

    return rows.mapInArrow(work, schema)


_LONG, _TEXT = ("bigint", pa.int64()), ("string", pa.string())


def _chunk_maps(rows):
    """(conv, chunk, segment, map) of each conversation's rows in a chunk, from (conv, seq, chunk, kind)."""
    for (chunk, conv), group in groupby(rows, lambda r: (r[2], r[0])):
        group = list(group)
        prices = range(len(price_numbers()[0]))
        for row in reversed(group):
            prices = [before(row[3], p) for p in prices]
        yield conv, chunk, group[0][1], bytes(prices)


def _exits(segments):
    """(chunk, segment, behind) from (conv, chunk, segment, map), the last segment of a conversation first."""
    for _, group in groupby(segments, lambda r: r[0]):
        behind = 0
        for _, chunk, segment, prices in group:
            yield chunk, segment, behind
            behind = prices[behind]


def _prices(rows):
    """(conv, seq, kind, fault, behind) of every row; a row of (conv, seq, kind, fault, behind) without kind opens a segment."""

    def backwards(held, behind):
        for conv, seq, kind, fault in reversed(held):
            yield conv, seq, kind, fault, behind
            behind = before(kind, behind)

    held, exit_price = [], 0
    for conv, seq, kind, fault, behind in rows:
        if kind is None:
            yield from backwards(held, exit_price)
            held, exit_price = [], behind
        else:
            held.append((conv, seq, kind, fault))
    yield from backwards(held, exit_price)


def _edits(rows):
    """One tuple per edit, from (conv, seq, kind, fault, behind, turn, role, text): of each seq the prices, then the row."""
    for conv, group in groupby(rows, lambda r: r[0]):
        state, place, priced = START, 0, None
        for _, _, kind, fault, behind, turn, role, text in group:
            if kind is not None:
                priced = kind, fault, behind
                continue
            kind, fault, behind = priced
            letters, after = moves_of(kind, behind)[state]
            for letter in letters:
                state = after if letter in "DK" else NEXT[state]
                if letter == "I":
                    yield conv, place, letter, INSERT, None, None, None, None, SAYS[state], ""
                elif letter == "D":
                    yield conv, place, letter, DELETE, fault, turn, role, text, None, None
                else:
                    cost = (KEEP if letter == "K" else REROLE) + (CUT_OFF if fault == TRUNCATED else 0)
                    yield conv, place, letter, cost, fault, turn, role, text, role if letter == "K" else SAYS[state], text
                place += 1
        for letter in moves_of(END, 0)[state][0]:
            state = NEXT[state]
            yield conv, place, letter, INSERT, None, None, None, None, SAYS[state], ""
            place += 1


def repair(rows: DataFrame, folder: str) -> DataFrame:
    """The cheapest edits of each conversation of ``rows`` (conv, turn, role, text).

    Gives (conv, place, edit, cost, fault, turn, role, text, new_role, new_text): an inserted turn has no fault, turn, role
    and text, a deleted one no new role and text. Those with a new role are the repaired conversation, by place.
    ``folder`` (shared, new) takes intermediate tables.
    """
    stored = _write(in_order(rows), f"{folder}/rows")
    marked = _write(marks(stored), f"{folder}/marks")
    whole = marked.select("conv", "seq", "chunk", "kind").repartition("chunk").sortWithinPartitions("seq")
    segments = _stream(whole, _chunk_maps, {"conv": _LONG, "chunk": _LONG, "segment": _LONG, "map": ("binary", pa.binary())})
    ends = segments.repartition("conv").sortWithinPartitions("conv", F.col("segment").desc())
    exits = _stream(ends, _exits, {"chunk": _LONG, "segment": _LONG, "behind": _LONG})
    opening = exits.select("chunk", F.col("segment").alias("seq"), "behind")
    both = marked.unionByName(opening, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("seq", F.col("kind").asc_nulls_first())
    priced = _stream(
        both.select("conv", "seq", "kind", "fault", "behind"),
        _prices,
        {"conv": _LONG, "seq": _LONG, "kind": _LONG, "fault": _LONG, "behind": _LONG},
    )
    # Prices and texts meet in the shuffle that puts a conversation's rows in order.
    turns = priced.unionByName(stored, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "seq", F.col("kind").desc_nulls_last())
    turn = stored.schema["turn"].dataType.simpleString()
    return _stream(
        turns.select("conv", "seq", "kind", "fault", "behind", F.col("turn").cast("bigint").alias("turn"), "role", "text"),
        _edits,
        {"conv": _LONG, "place": _LONG, "edit": _TEXT, "cost": _LONG, "fault": _LONG, "turn": _LONG}
        | {c: _TEXT for c in ("role", "text", "new_role", "new_text")},
    ).withColumn("turn", F.col("turn").cast(turn))


def _reports(rows):
    """One tuple per conversation from its edits in order; the first row, without an edit, only names it."""
    for conv, group in groupby(rows, lambda r: r[0]):
        faults, illegal, cost, audit, digest = [0] * 4, 0, 0, [], hashlib.sha256()
        least = most = initial = None
        turns, said = 0, False
        for _, _, edit, more, fault, turn, role, new_role, new_text in group:
            if edit is None:
                continue
            audit.append(edit)
            cost += more
            if role is not None:
                faults[fault] += 1
                illegal += initial is not None and initial + role[:1] not in LEGAL_PAIRS
                initial = role[:1]
                if turn is not None:
                    least = turn if least is None else least
                    turns += turn != most
                    most = turn
            if new_role is not None:
                digest.update(f"{chr(10) if said else ''}{new_role}:{new_text}".encode())
                said = True
        gaps = 0 if least is None else most - least + 1 - turns
        yield conv, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, "".join(audit), digest.hexdigest()


def report(edits: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Faults, cost, edits and the digest of the repaired text of every conversation, also of those without rows."""
    names = conversations.select(F.col(conv).alias("conv")).distinct()
    steps = edits.select("conv", "place", "edit", "cost", "fault", F.col("turn").cast("bigint").alias("turn"), "role", "new_role", "new_text")
    ordered = steps.unionByName(names, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", F.col("place").asc_nulls_first())
    counts = {c: _LONG for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    found = _stream(ordered, _reports, {"conv": _LONG} | counts | {"audit": _TEXT, "repaired_sha256": _TEXT})
    return found.withColumnRenamed("conv", conv)
