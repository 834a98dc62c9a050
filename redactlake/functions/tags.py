"""Segmentation, masking, tag rendering and splicing as SQL expressions.

They are written as SQL text, which the driver hands to Spark in one piece; assembling the
same trees call by call costs more than planning the query. Arguments named ``text`` are column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from . import text as T

# Code points Unicode sets aside for internal use; they do not occur in text proper.
NONCHARACTERS = [chr((plane << 16) | low) for plane in range(16, -1, -1) for low in (0xFFFF, 0xFFFE)] + [
    chr(c) for c in range(0xFDD0, 0xFDF0)
]
BLOCK = 4096


def quoted(name: str) -> str:
    """A column name as SQL."""
    return "`" + name.replace("`", "``") + "`"


def _pieces(text: str, pattern: str, mark: str) -> str:
    """Alternate gaps and regex hits of ``text`` as array<struct<piece, is_hit>>, empties dropped.

    Texts without the literal ``mark`` skip the regex altogether.
    """
    return f"""
      filter(
        if(contains({text}, '{mark}'),
          flatten(zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0),
            (gap, hit) -> array(struct(gap AS piece, false AS is_hit), struct(coalesce(hit, '') AS piece, true AS is_hit)))),
          array(struct({text} AS piece, false AS is_hit))),
        p -> length(p.piece) > 0)"""


def segments(text: str) -> Column:
    """Split at triple-backtick fences, in time linear in the text and its fences.

    array<struct<seg_no int, seg_start int, chunk string, redactable boolean>>
    """
    return kernels.make_segmenter().asNondeterministic()(F.col(quoted(text)))


def _masked(text: str) -> str:
    return f"""
      if(contains({text}, '{T.TAG_HEAD}'),
        array_join(transform({_pieces(text, T.TAG, T.TAG_HEAD)},
          p -> if(p.is_hit, repeat('{T.MASK}', length(p.piece)), p.piece)), ''),
        {text})"""


def mask_tags(text: str) -> Column:
    """Existing tags become as many mask characters; the length is kept."""
    return F.expr(_masked(quoted(text)))


def searchable(text: str, fill: str) -> Column:
    """The text as the matcher sees it: tags masked chunk by chunk, fences filled, length kept.

    ``fill`` must not occur in any surface.
    """
    text = quoted(text)
    return F.expr(f"""
      if(contains({text}, '```'),
        array_join(transform({_pieces(text, T.FENCE, '```')},
          f -> if(f.is_hit, repeat('{fill}', length(f.piece)), {_masked('f.piece')})), ''),
        {_masked(text)})""")


def _tag(m: str) -> str:
    return f"""concat('[REDACTED(#', {m}.item_id, '|var=', if({m}.variant = 'c', 'c', concat('a', {m}.alias_id)),
      '): ', {m}.code, ', ', {m}.desc, ']')"""


def render_tags(matches: str) -> Column:
    """Matches as spans (start, end, tag)."""
    return F.expr(f"transform({matches}, m -> struct(m.start AS start, m.end AS end, {_tag('m')} AS tag))")


def splice(df: DataFrame, text: str, spans: str, name: str) -> DataFrame:
    """Add ``name``: the text with its sorted, disjoint ``spans`` (start, end, tag) replaced by their tags.

    ``substring`` counts characters from the front, so cutting N gaps out of a long text one by
    one is quadratic. The text is cut once into blocks and each gap reads only the blocks it
    covers, which keeps the whole splice linear. There is one gap more than there are spans;
    the last is the tail.
    """
    text = quoted(text)
    until = f"coalesce(s.start, length({text}))"
    gap = f"""
      CASE WHEN {until} <= at THEN ''
        WHEN size(_blocks) = 1 THEN substring({text}, at + 1, {until} - at)
        ELSE substring(
          array_join(slice(_blocks, at div {BLOCK} + 1, ({until} - 1) div {BLOCK} - at div {BLOCK} + 1), ''),
          at % {BLOCK} + 1, {until} - at)
      END"""
    pieces = f"""
      zip_with({spans}, concat(array(0), transform({spans}, s -> s.end)),
        (s, at) -> concat({gap}, if(s IS NULL, '', coalesce(s.tag, cast(raise_error('a span has no tag') AS string)))))"""
    return (
        df.withColumn(
            "_blocks", F.expr(f"if(size({spans}) > 0, regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}', 0), NULL)")
        )
        .withColumn(name, F.expr(f"if(size({spans}) > 0, array_join({pieces}, ''), {text})"))
        .drop("_blocks")
    )


def tag_pieces(text: str) -> Column:
    """Tags of a text with the gap before each and the tail at the end; empty without any tag head.

    array<struct<pos int, gap string, tag string, item_id bigint, alias_id bigint>>; ``alias_id``
    is null for the canonical variant and ``tag`` is null for the tail.
    """
    text = quoted(text)
    # A tag starts "[REDACTED(#<id>|var=<variant>)", so its parts need no further regex.
    item = "substring_index(substring(z.`1`, 12), '|', 1)"
    alias = f"if(substring(z.`1`, length({item}) + 17, 1) = 'c', NULL, substring_index(substring(z.`1`, length({item}) + 18), ')', 1))"
    return F.expr(f"""
      if(contains({text}, '{T.TAG_HEAD}'),
        transform(
          arrays_zip(split({text}, r'{T.TAG}', -1), regexp_extract_all({text}, r'{T.TAG}', 0)),
          (z, i) -> struct(i AS pos, z.`0` AS gap, z.`1` AS tag, {T.number(item)} AS item_id, {T.number(alias)} AS alias_id)),
        array())""")
