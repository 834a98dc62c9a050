"""String expressions shared by every operator (JVM-side, code-point based)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# --- fixed values: formats that must stay as they are for results to agree ---
CODE = r"\([1-4]\)\([A-EX]\)(?:\([a-ex]\))?"
FENCE = r"(?dms)^```.*?$.*?^```$"
TAG = r"(?Ud)\[REDACTED\(#(\d+)\|var=(c|a\d+)\):WS*[^,]+,WS*[^\]]+\]"
BADGE_ARROW = r"(?Ud)^WS*\[REDACTED:WS*(CODE)WS*,WS*([^\]]+?)\]WS*=>WS*(.+?)WS*\z"
BADGE_PIPE = r"(?Ud)^WS*(CODE)WS*\|WS*([^|]+?)WS*\|WS*(.+?)WS*\z"
TAG_HEAD = "[REDACTED(#"
MASK = "■"
TEXT_EXTENSIONS = (".md", ".markdown", ".txt", ".0", ".asc", ".csv", ".odt", ".rtf")
# --- end of fixed values ---

# Java's Unicode \s leaves out the four separator controls U+001C..U+001F.
WS = r"[\s\x1C-\x1F]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

CODE_FULL = rf"\A{CODE}\z"
TAG = TAG.replace("WS", WS)
BADGE_ARROW = BADGE_ARROW.replace("WS", WS).replace("CODE", CODE)
BADGE_PIPE = BADGE_PIPE.replace("WS", WS).replace("CODE", CODE)


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def strip_sql(sql: str) -> str:
    return rf"regexp_replace({sql}, r'(?U)\A{WS}+|{WS}+\z', '')"


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+\z", "")


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fold_newlines(c: Column) -> Column:
    """CRLF and lone CR become LF, as a text-mode file read does."""
    return F.regexp_replace(c, "\r\n?", "\n")


def is_code(c: Column) -> Column:
    return c.rlike(CODE_FULL)


def code_parts(c: Column) -> dict[str, Column]:
    """The three levels of a classification code; ``fine`` is null when absent."""
    letters = F.regexp_extract_all(c, F.lit(r"\((.)\)"), F.lit(1))
    return {
        "grp": F.get(letters, F.lit(0)),
        "sub": F.get(letters, F.lit(1)),
        "fine": F.get(letters, F.lit(2)),
    }


def _decimal_digits() -> tuple[str, str]:
    digits = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(i), None) is not None]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


def number(sql: str) -> str:
    """SQL: digits of any script to a long; null when it does not fit one."""
    source, target = _decimal_digits()
    return f"try_cast(translate({sql}, '{source}', '{target}') AS bigint)"


def schema_with(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` and one column more."""
    return StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])
