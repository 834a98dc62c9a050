"""The matching semantics from their definitions, slow and plain, to test against."""

import re

#: What a fence line and a tag look like.
FENCE = "```"
TAG = re.compile(r"\[REDACTED\(#(\d+)\|var=(c|a\d+)\):\s*[^,]+,\s*[^\]]+\]")


def fenced_ranges(text):
    """(begin, end) from a line that opens with a fence to the next line that is nothing but one."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    found, n = [], 0
    while n < len(lines):
        closing = next((k for k in range(n + 1, len(lines)) if lines[k][1] == FENCE), None)
        if lines[n][1].startswith(FENCE) and closing is not None:
            found.append((lines[n][0], lines[closing][0] + len(FENCE)))
            n = closing
        n += 1
    return found


def chunks(text):
    """(begin, piece, is prose), cut wherever a fenced range begins or ends."""
    ranges = fenced_ranges(text)
    cuts = sorted({0, len(text), *(p for r in ranges for p in r)})
    return [(a, text[a:b], (a, b) not in ranges) for a, b in zip(cuts, cuts[1:])]


def occurrences(text, surfaces):
    """All (begin, end, surface) outside fences and tags."""
    taken = [False] * len(text)
    for base, piece, prose in chunks(text):
        for tag in TAG.finditer(piece) if prose else ():
            taken[base + tag.start() : base + tag.end()] = [True] * len(tag.group())
    hits = []
    for base, piece, prose in chunks(text):
        for s in surfaces if prose else ():
            p = piece.find(s)
            while p >= 0:
                here = base + p
                # A tag is searched as a row of mask characters, so only those may match in one.
                if all(not taken[here + k] or s[k] == "■" for k in range(len(s))):
                    hits.append((here, here + len(s), s))
                p = piece.find(s, p + 1)
    return hits + masked_hits(text, surfaces, taken)


def masked_hits(text, surfaces, taken):
    """Surfaces of mask characters, found where tags stand."""
    hits = []
    for base, piece, prose in chunks(text):
        seen = "".join("■" if taken[base + k] else c for k, c in enumerate(piece))
        for s in surfaces if prose and seen != piece else ():
            for p in range(len(seen) - len(s) + 1):
                if seen[p : p + len(s)] == s != piece[p : p + len(s)]:
                    hits.append((base + p, base + p + len(s), s))
    return hits


def greedy(spans):
    """Keep the earliest, of those the longest; drop all it overlaps; again with the rest."""
    rest, kept = list(spans), []
    while rest:
        best = min(rest, key=lambda s: (s[0], -s[1]))
        kept.append(best)
        rest = [s for s in rest if s[0] >= best[1]]
    return kept


def redact(text, tags):
    """``tags`` maps each surface to its tag."""
    spans = greedy(occurrences(text, tags))
    for start, end, s in reversed(spans):
        text = text[:start] + tags[s] + text[end:]
    return text, len(spans)
