"""The same queries in SQL for another engine, written independently of the operators.

Matching enumerates occurrences by repeated search, selection and merging walk rows in order
with recursive CTEs, and tags are read with regular expressions.
"""

from __future__ import annotations

from . import derived
from .derived import for_duckdb as d

ORACLES: dict[str, str] = {}

# Formats of codes, badge lines, tags and fences, which results must follow.
CODE = r"\([1-4]\)\([A-EX]\)(?:\([a-ex]\))?"
ARROW = rf"^\s*\[REDACTED:\s*({CODE})\s*,\s*([^\]]+?)\]\s*=>\s*(.+?)\s*$"
PIPE = rf"^\s*({CODE})\s*\|\s*([^|]+?)\s*\|\s*(.+?)\s*$"
TAG = r"\[REDACTED\(#(\d+)\|var=(c|a\d+)\):\s*[^,]+,\s*[^\]]+\]"
FENCE = r"(?ms)^```.*?$.*?^```$"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"[0-9]{16}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
# End of fixed values. The display lines of listings and snapshots below are fixed formats too.


# --- badges -----------------------------------------------------------------


def parsed(lines: str) -> str:
    return f"""(
      SELECT src, line_no, raw, kind,
        CASE kind WHEN 'arrow' THEN regexp_extract(line, '{ARROW}', 1) WHEN 'pipe' THEN regexp_extract(line, '{PIPE}', 1) END AS code,
        CASE kind WHEN 'arrow' THEN trim(regexp_extract(line, '{ARROW}', 2)) WHEN 'pipe' THEN trim(regexp_extract(line, '{PIPE}', 2)) END AS "desc",
        CASE kind WHEN 'arrow' THEN regexp_extract(line, '{ARROW}', 3) WHEN 'pipe' THEN regexp_extract(line, '{PIPE}', 3) END AS surface,
        CASE kind WHEN 'invalid' THEN 'Error parsing line ' || line_no || ': Invalid badge line format: ' || line END AS error
      FROM (SELECT *, trim(raw) AS line,
          CASE WHEN trim(raw) = '' OR starts_with(trim(raw), '#') THEN 'skip'
            WHEN regexp_matches(trim(raw), '{ARROW}') THEN 'arrow'
            WHEN regexp_matches(trim(raw), '{PIPE}') THEN 'pipe' ELSE 'invalid' END AS kind
        FROM {lines} l) k)"""


ORACLES["badge_parse_arrow"] = f'SELECT line_no, kind, code, "desc", surface FROM {parsed(d("arrow_lines"))} p'
ORACLES["badge_parse_pipe"] = f'SELECT line_no, kind, code, "desc", surface FROM {parsed(d("pipe_lines"))} p'
_both = f"(SELECT * FROM {d('arrow_lines')} a UNION ALL SELECT * FROM {d('pipe_lines')} b)"
ORACLES["badge_errors"] = f"SELECT src, line_no, error FROM {parsed(_both)} p WHERE kind = 'invalid'"
ORACLES["badge_validate_counts"] = f"""
  SELECT cast(src AS BIGINT) AS src, count(*) FILTER (kind IN ('arrow', 'pipe')) AS n_valid,
    count(*) FILTER (rtrim(raw) = '' OR starts_with(raw, '#')) AS n_skipped,
    arg_min(error, line_no) FILTER (error IS NOT NULL) AS first_error
  FROM {parsed(d("arrow_lines"))} p GROUP BY src"""
ORACLES["code_filter"] = f"""
  SELECT c_custkey, code, substr(code, 2, 1) AS grp, substr(code, 5, 1) AS sub,
    CASE WHEN length(code) > 6 THEN substr(code, 8, 1) END AS fine
  FROM {d("codes")} c WHERE regexp_full_match(code, '{CODE}')"""
ORACLES["split_lines"] = r"""
  SELECT doc_id, line_no, md5(lines[line_no]) AS line_md5 FROM (
    SELECT doc_id, lines, unnest(generate_series(1, CASE WHEN lines[-1] = '' THEN len(lines) - 1 ELSE len(lines) END)) AS line_no
    FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS lines FROM documents) s) n"""


# --- proposals and inventory ------------------------------------------------


def _hits(rule: int, code: str, desc: str, pattern: str) -> str:
    return f"""
      SELECT doc_id, {rule} AS rule, '{code}' AS code, '{desc}' AS descr, surface, min(pos) AS pos FROM (
        SELECT doc_id, unnest(hits) AS surface, generate_subscripts(hits, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits FROM documents) h) u
      GROUP BY doc_id, surface"""


BADGES = f"""badges AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) AS line_no, code, descr, surface FROM (
      {_hits(1, "(1)(A)(c)", "email address", MAIL)} UNION ALL
      {_hits(2, "(1)(B)(c)", "card number", CARD)} UNION ALL
      {_hits(3, "(3)(B)(a)", "IP address", IPV4)}) r)"""
ITEMS = """items AS (
    SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, code, descr, surface FROM (
      SELECT *, row_number() OVER (PARTITION BY code, surface ORDER BY doc_id, line_no) AS nth FROM badges) f
    WHERE nth = 1)"""
# Equal surfaces: the later item wins.
DOC_PATTERNS = """patterns AS (
    SELECT surface, max(id) AS item_id, arg_max(code, id) AS code, arg_max(descr, id) AS descr,
      'c' AS variant, cast(NULL AS BIGINT) AS alias_id FROM items GROUP BY surface)"""
DOC_INVENTORY = f"{BADGES}, {ITEMS}, {DOC_PATTERNS}"

ORACLES["propose_badges"] = f'WITH {BADGES} SELECT doc_id, line_no, code, descr AS "desc", surface FROM badges'
ORACLES["propose_with_hook"] = f"""
  SELECT doc_id, generate_subscripts(hits, 1) AS line_no, '(1)(A)(c)' AS code, 'email address' AS "desc", unnest(hits) AS surface
  FROM (SELECT doc_id, regexp_extract_all(text, '{MAIL}') AS hits FROM documents) h"""
ORACLES["import_inventory"] = f"""
  WITH {BADGES}, {ITEMS} SELECT id - 1 AS item_pos, id, code, descr AS "desc", surface, 'global' AS scope FROM items"""

_MERGE = f"""
  existing AS (SELECT * FROM {d("supplier_items")} i), alt AS (SELECT * FROM {d("supplier_aliases")} a),
  b AS (SELECT ord, code, descr, trim(surface) AS surface FROM {d("customer_badges")} c),
  hit AS (
    SELECT b.ord, min(e.item_pos) AS item_pos FROM b JOIN existing e ON e.code = b.code
      AND (e.surface = b.surface OR (e.descr = b.descr AND EXISTS (
        SELECT 1 FROM alt WHERE alt.item_pos = e.item_pos AND alt.surface = b.surface)))
    GROUP BY b.ord),
  missed AS (SELECT b.* FROM b ANTI JOIN hit ON hit.ord = b.ord),
  created AS (
    SELECT row_number() OVER (ORDER BY ord) AS nth, code, descr, surface FROM (
      SELECT *, row_number() OVER (PARTITION BY code, surface ORDER BY ord) AS seen FROM missed) m
    WHERE seen = 1),
  last AS (SELECT max(id) AS id, max(item_pos) AS item_pos FROM existing)"""
ORACLES["merge_existing"] = f"""
  WITH {_MERGE}
  SELECT b.ord, b.code, b.descr AS "desc", b.surface, coalesce(e.id, last.id + created.nth) AS item_id, e.id IS NULL AS is_new
  FROM b CROSS JOIN last LEFT JOIN hit ON hit.ord = b.ord LEFT JOIN existing e ON e.item_pos = hit.item_pos
    LEFT JOIN created ON created.code = b.code AND created.surface = b.surface"""
ORACLES["merge_upsert"] = f"""
  WITH {_MERGE}
  SELECT item_pos, id, code, descr AS "desc", surface, scope FROM existing
  UNION ALL SELECT last.item_pos + nth, last.id + nth, code, descr, surface, 'global' FROM created CROSS JOIN last"""
ORACLES["next_id"] = "SELECT max(c_custkey) + 2 AS next_id FROM customer"

_ALIAS_ADD = f"""
  items AS (SELECT * FROM {d("customer_items")} i), alt AS (SELECT * FROM {d("customer_aliases")} a),
  r AS (SELECT ord, item_id, trim(surface) AS surface FROM {d("alias_requests")} q),
  firsts AS (
    SELECT r.item_id, r.surface, min(r.ord) AS ord FROM r JOIN items i ON i.id = r.item_id
    WHERE r.surface <> i.surface AND NOT EXISTS (SELECT 1 FROM alt WHERE alt.item_id = r.item_id AND alt.surface = r.surface)
    GROUP BY r.item_id, r.surface),
  tops AS (SELECT item_id, max(alias_id) AS top_id, max(alias_pos) AS top_pos FROM alt GROUP BY item_id),
  added AS (
    SELECT f.*, t.top_id + row_number() OVER w AS alias_id, t.top_pos + row_number() OVER w AS alias_pos
    FROM firsts f JOIN tops t ON t.item_id = f.item_id WINDOW w AS (PARTITION BY f.item_id ORDER BY f.ord))"""
ORACLES["alias_add"] = f"""
  WITH {_ALIAS_ADD}
  SELECT r.ord, r.item_id, r.surface, coalesce(a.alias_id, 0) AS alias_id FROM r LEFT JOIN added a ON a.ord = r.ord"""
ORACLES["alias_append"] = f"""
  WITH {_ALIAS_ADD}
  SELECT item_pos, item_id, alias_pos, alias_id, surface FROM alt
  UNION ALL SELECT item_id - 1, item_id, alias_pos, alias_id, surface FROM added"""
ORACLES["item_lookup"] = f"""
  SELECT k.o_orderkey, k.item_id, i.code, i.descr AS "desc", i.surface
  FROM {d("alias_keys")} k LEFT JOIN {d("customer_items")} i ON i.id = k.item_id"""
ORACLES["alias_lookup"] = f"""
  SELECT k.o_orderkey, k.item_id, k.alias_id, a.surface
  FROM {d("alias_keys")} k LEFT JOIN {d("customer_aliases")} a ON a.item_id = k.item_id AND a.alias_id = k.alias_id"""


def all_patterns(items: str, aliases: str) -> str:
    """Canonical and alias surfaces; of equal ones the last in list order."""
    return f"""
      SELECT surface, item_id, code, descr, variant, alias_id FROM (
        SELECT *, row_number() OVER (PARTITION BY surface ORDER BY item_pos DESC, alias_pos DESC) AS nth FROM (
          SELECT item_pos, -1 AS alias_pos, surface, id AS item_id, code, descr, 'c' AS variant, cast(NULL AS BIGINT) AS alias_id
          FROM {items} i
          UNION ALL
          SELECT i.item_pos, a.alias_pos, a.surface, i.id, i.code, i.descr, 'a', a.alias_id
          FROM {items} i JOIN {aliases} a ON a.item_pos = i.item_pos) u) n
      WHERE nth = 1"""


_equal = all_patterns(d("equal_items"), d("equal_aliases"))
_customer = all_patterns(d("customer_items"), d("customer_aliases"))
ORACLES["pattern_set"] = f'SELECT surface, item_id, code, descr AS "desc", variant, alias_id FROM ({_equal}) p'
ORACLES["inventory_store"] = f'SELECT surface, item_id, code, descr AS "desc", variant, alias_id FROM ({_customer}) p'
_notes = f"""(SELECT item_pos, string_agg(alias_id || ':' || surface, ', ' ORDER BY alias_pos) AS note
  FROM {d("customer_aliases")} a GROUP BY item_pos)"""
ORACLES["list_items"] = f"""
  SELECT i.id AS item_id, code, descr AS "desc", surface, note AS alias_note,
    '- #' || i.id || ' ' || code || ': ' || descr || ' (' || surface || ')'
      || CASE WHEN note IS NULL THEN '' ELSE '  (aliases: ' || note || ')' END AS line
  FROM {d("customer_items")} i LEFT JOIN {_notes} n ON n.item_pos = i.item_pos"""
ORACLES["alias_list"] = f"""
  SELECT item_id, alias_pos, alias_id, surface FROM {d("customer_aliases")} a
  WHERE item_id = (SELECT max(c_custkey) + 1 FROM customer)"""
_SNAPSHOT = f"""(
  SELECT string_agg('- #' || id || ' ' || code || ' :: ' || descr || ' :: ' || surface, chr(10) ORDER BY nth)
    || CASE WHEN max(total) > 200 THEN chr(10) || '... (truncated; ' || (max(total) - 200) || ' more items)' ELSE '' END AS snapshot
  FROM (SELECT *, row_number() OVER (ORDER BY code, surface) AS nth, count(*) OVER () AS total FROM {d("customer_items")} i) s
  WHERE nth <= 200)"""
ORACLES["inventory_snapshot"] = f"SELECT snapshot FROM {_SNAPSHOT} s"
ORACLES["inventory_json"] = f"""
  SELECT item_pos, id, surface, cast(-1 AS BIGINT) AS alias_pos, code, descr AS "desc" FROM {d("customer_items")} i
  UNION ALL SELECT item_pos, alias_id, surface, alias_pos, NULL, NULL FROM {d("customer_aliases")} a"""


def _prompt_oracle() -> str:
    from ..operators.propose import PromptTemplate

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    t = PromptTemplate()
    head = f"{t.opening}\n\n--- Policy ---\n\nThe policy.\n\n--- Output rules ---\n\n{t.rules}\n\n--- Known items ---\n\n"
    tail = f"\n\n--- Task ---\n\n{t.task}"
    user = f"{quote(head)} || snapshot || {quote(chr(10) * 2 + '--- Text ---' + chr(10) * 2)} || text || {quote(tail)}"
    return f"SELECT doc_id, length({user}) AS n_chars, md5({user}) AS user_md5 FROM documents CROSS JOIN {_SNAPSHOT} s"


ORACLES["build_prompts"] = _prompt_oracle()


# --- segments and masks -------------------------------------------------------


def segments(docs: str) -> str:
    """(doc_id, seg_no, seg_start, chunk, redactable) of the non-empty segments."""
    return f"""(
      SELECT doc_id, row_number() OVER w - 1 AS seg_no,
        cast(coalesce(sum(length(chunk)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start,
        chunk, redactable
      FROM (
        SELECT doc_id, k, unnest([gaps[k], coalesce(fences[k], '')]) AS chunk, unnest([true, false]) AS redactable, unnest([0, 1]) AS half
        FROM (SELECT doc_id, gaps, fences, unnest(generate_series(1, len(gaps))) AS k FROM (
          SELECT doc_id, string_split_regex(text, '{FENCE}') AS gaps, regexp_extract_all(text, '{FENCE}') AS fences
          FROM {docs} t) s) e) c
      WHERE chunk <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k, half))"""


def masked(text: str) -> str:
    """Tags as runs of the mask character."""
    return f"""list_aggregate(list_transform(generate_series(1, len(string_split_regex({text}, '{TAG}'))),
      lambda i: string_split_regex({text}, '{TAG}')[i]
        || repeat('■', coalesce(length(regexp_extract_all({text}, '{TAG}')[i]), 0))), 'string_agg', '')"""


ORACLES["segment_markdown"] = f"SELECT * FROM {segments(d('markdown'))} s"
ORACLES["mask_tags"] = f"SELECT doc_id, {masked('text')} AS masked FROM {d('tagged')} t"


# --- matching, selection, rendering ----------------------------------------------


def matches(docs: str, prefix: str) -> str:
    """CTEs up to ``hits``: every occurrence with its segment. Needs a CTE ``patterns``."""
    return f"""
      {prefix}docs AS (SELECT doc_id, text FROM {docs} t),
      {prefix}segs AS (SELECT *, {masked('chunk')} AS seen FROM {segments(prefix + 'docs')} s WHERE redactable),
      {prefix}found AS (
        SELECT s.doc_id, s.seg_no, s.seg_start, p.surface, strpos(s.seen, p.surface) AS pos
        FROM {prefix}segs s JOIN patterns p ON contains(s.seen, p.surface)
        UNION ALL
        SELECT f.doc_id, f.seg_no, f.seg_start, f.surface, f.pos + strpos(substr(s.seen, f.pos + 1), f.surface)
        FROM {prefix}found f JOIN {prefix}segs s ON s.doc_id = f.doc_id AND s.seg_no = f.seg_no
        WHERE strpos(substr(s.seen, f.pos + 1), f.surface) > 0),
      {prefix}hits AS (
        SELECT f.doc_id, f.seg_no, f.seg_start, f.pos - 1 AS s, f.pos - 1 + length(f.surface) AS e,
          f.seg_start + f.pos - 1 AS ds, f.seg_start + f.pos - 1 + length(f.surface) AS de,
          p.surface, p.item_id, p.code, p.descr, p.variant, p.alias_id
        FROM {prefix}found f JOIN patterns p ON p.surface = f.surface)"""


def selected(prefix: str) -> str:
    """CTE ``kept``: greedy walk over the hits of each document, by (start, longest first)."""
    return f"""
      {prefix}ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ds, de DESC) AS rn FROM {prefix}hits),
      {prefix}walk AS (
        SELECT doc_id, rn, true AS keep, de AS last FROM {prefix}ranked WHERE rn = 1
        UNION ALL
        SELECT r.doc_id, r.rn, r.ds >= w.last, CASE WHEN r.ds >= w.last THEN r.de ELSE w.last END
        FROM {prefix}walk w JOIN {prefix}ranked r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1),
      {prefix}kept AS (SELECT r.* FROM {prefix}ranked r JOIN {prefix}walk w ON w.doc_id = r.doc_id AND w.rn = r.rn WHERE w.keep)"""


def rendered(prefix: str) -> str:
    """CTE ``redacted``: (doc_id, n_matches, redacted)."""
    tag = """'[REDACTED(#' || item_id || '|var=' || CASE variant WHEN 'c' THEN 'c' ELSE 'a' || alias_id END || '): '
            || code || ', ' || descr || ']'"""
    return f"""
      {prefix}parts AS (
        SELECT k.doc_id, k.ds, k.de, substr(t.text, prev + 1, k.ds - prev) || {tag} AS part
        FROM (SELECT *, coalesce(lag(de) OVER (PARTITION BY doc_id ORDER BY ds), 0) AS prev FROM {prefix}kept) k
          JOIN {prefix}docs t ON t.doc_id = k.doc_id),
      {prefix}joined AS (
        SELECT doc_id, count(*) AS n, max(de) AS last, string_agg(part, '' ORDER BY ds) AS head FROM {prefix}parts GROUP BY doc_id),
      {prefix}redacted AS (
        SELECT t.doc_id, coalesce(j.n, 0) AS n_matches,
          CASE WHEN j.n IS NULL THEN t.text ELSE j.head || substr(t.text, j.last + 1) END AS redacted
        FROM {prefix}docs t LEFT JOIN {prefix}joined j ON j.doc_id = t.doc_id)"""


def redaction(docs: str, prefix: str = "") -> str:
    return f"{matches(docs, prefix)}, {selected(prefix)}, {rendered(prefix)}"


def restored(texts: str, owners: str, aliases: str) -> str:
    """CTEs up to ``restored``: (doc_id, n_tags, restored). ``texts`` has (doc_id, text)."""
    return f"""
      tagged AS (
        SELECT doc_id, string_split_regex(text, '{TAG}') AS gaps, regexp_extract_all(text, '{TAG}') AS marks,
          regexp_extract_all(text, '{TAG}', 1) AS ids, regexp_extract_all(text, '{TAG}', 2) AS vars
        FROM {texts} x),
      pieces AS (
        SELECT doc_id, k, gaps[k] AS gap, coalesce(marks[k], '') AS mark, try_cast(ids[k] AS BIGINT) AS item_id,
          try_cast(substr(vars[k], 2) AS BIGINT) AS alias_id
        FROM (SELECT *, unnest(generate_series(1, len(gaps))) AS k FROM tagged) g),
      restored AS (
        SELECT p.doc_id, count(*) - 1 AS n_tags,
          string_agg(p.gap || coalesce(CASE WHEN o.surface IS NOT NULL THEN coalesce(a.surface, o.surface) END, p.mark), '' ORDER BY k) AS restored
        FROM pieces p LEFT JOIN {owners} o ON o.id = p.item_id
          LEFT JOIN {aliases} a ON a.item_id = p.item_id AND a.alias_id = p.alias_id
        GROUP BY p.doc_id)"""


_ROWS = "doc_id, ds AS doc_start, s AS start, e AS \"end\", seg_no, item_id, variant, alias_id, surface"
_CUSTOMER_PATTERNS = f"patterns AS ({_customer})"
_LONG_WORDS = """(SELECT row_number() OVER (ORDER BY conv_id, turn, place) AS item_pos, word FROM (
    SELECT * FROM (
      SELECT conv_id, turn, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word
      FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]{6,}') AS words FROM conversations) t) u
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY conv_id, turn, place) = 1) p)"""
_words = f"""(SELECT item_pos, item_pos + 1 AS id, '(1)(A)(b)' AS code, 'word' AS descr, word AS surface FROM {_LONG_WORDS} w)"""
_word_alts = f"""(SELECT item_pos, cast(0 AS BIGINT) AS alias_pos, cast(1 AS BIGINT) AS alias_id, lower(word) AS surface FROM {_LONG_WORDS} w)"""
_WORD_PATTERNS = f"patterns AS ({all_patterns(_words, _word_alts)})"
_TURNS = "(SELECT concat(conv_id, ':', turn) AS doc_id, text FROM conversations)"
_HOST_PATTERNS = f"""patterns AS (SELECT host AS surface, item_pos + 1 AS item_id, '(3)(B)(c)' AS code, 'host name' AS descr,
    'c' AS variant, cast(NULL AS BIGINT) AS alias_id FROM {d("hosts")} h)"""
_NO_ALIASES = "(SELECT cast(0 AS BIGINT) AS item_id, cast(0 AS BIGINT) AS alias_id, '' AS surface WHERE false)"

ORACLES["match_all"] = f"WITH RECURSIVE {DOC_INVENTORY}, {matches('documents', '')} SELECT {_ROWS} FROM hits"
ORACLES["match_all_large_inventory"] = ORACLES["match_all"]
ORACLES["match_markdown"] = f"WITH RECURSIVE {_CUSTOMER_PATTERNS}, {matches(d('markdown'), '')} SELECT {_ROWS} FROM hits"
ORACLES["select_spans"] = f"""
  WITH RECURSIVE hits AS (SELECT doc_id, start AS ds, stop AS de FROM {d("spans")} x), {selected('')}
  SELECT doc_id, ds AS start, de AS stop FROM kept"""
ORACLES["select_matches"] = f"WITH RECURSIVE {_WORD_PATTERNS}, {matches(_TURNS, '')}, {selected('')} SELECT {_ROWS} FROM kept"
_redact_documents = f"WITH RECURSIVE {DOC_INVENTORY}, {redaction('documents')}"
ORACLES["redact_documents"] = f"{_redact_documents} SELECT doc_id, n_matches, redacted FROM redacted"
ORACLES["redact_documents_large_inventory"] = ORACLES["redact_documents"]
ORACLES["autoredact_documents"] = ORACLES["redact_documents"]
ORACLES["redact_markdown"] = f"""
  WITH RECURSIVE {_CUSTOMER_PATTERNS}, {redaction(d('markdown'))} SELECT doc_id, n_matches, redacted FROM redacted"""
ORACLES["redact_conversations"] = f"""
  WITH RECURSIVE {_WORD_PATTERNS}, {redaction(_TURNS)} SELECT doc_id, n_matches, redacted FROM redacted"""
ORACLES["redact_pages"] = f"""
  WITH RECURSIVE {_HOST_PATTERNS}, {redaction('(SELECT page_id AS doc_id, html AS text FROM pages)')}
  SELECT doc_id AS page_id, n_matches, redacted FROM redacted"""
ORACLES["match_counts"] = f"{_redact_documents} SELECT doc_id, n_matches FROM redacted"
ORACLES["match_total"] = f"""
  {_redact_documents} SELECT count(*) AS n_documents, cast(sum(n_matches) AS BIGINT) AS n_matches,
    count(*) FILTER (n_matches > 0) AS n_changed FROM redacted"""


# --- restoring and audits -----------------------------------------------------

ORACLES["parse_tags"] = f"""
  SELECT doc_id, k - 1 AS pos, marks[k] AS tag, try_cast(ids[k] AS BIGINT) AS item_id, try_cast(substr(vars[k], 2) AS BIGINT) AS alias_id
  FROM (SELECT *, unnest(generate_series(1, len(marks))) AS k FROM (
    SELECT doc_id, regexp_extract_all(text, '{TAG}') AS marks, regexp_extract_all(text, '{TAG}', 1) AS ids,
      regexp_extract_all(text, '{TAG}', 2) AS vars FROM {d("tagged")} t) s) e"""
ORACLES["restore_tagged"] = f"""
  WITH {restored(d("tagged"), d("customer_items"), d("customer_aliases"))} SELECT doc_id, n_tags, restored FROM restored"""
ORACLES["restore_tagged_large_inventory"] = ORACLES["restore_tagged"]
_back = restored("(SELECT doc_id, redacted AS text FROM redacted)", "items", _NO_ALIASES)
ORACLES["unredact_documents"] = f"{_redact_documents}, {_back} SELECT doc_id, n_tags, restored FROM restored"
_audit = """SELECT r.doc_id, r.n_matches, b.n_tags, b.restored = t.text AS is_equal
  FROM redacted r JOIN restored b ON b.doc_id = r.doc_id JOIN docs t ON t.doc_id = r.doc_id"""
ORACLES["roundtrip_audit"] = f"{_redact_documents}, {_back} {_audit}"
_back_markdown = restored("(SELECT doc_id, redacted AS text FROM redacted)", d("customer_items"), d("customer_aliases"))
ORACLES["roundtrip_audit_markdown"] = f"""
  WITH RECURSIVE {_CUSTOMER_PATTERNS}, {redaction(d('markdown'))}, {_back_markdown} {_audit}"""
ORACLES["idempotency_audit"] = f"""
  {_redact_documents}, {redaction('(SELECT doc_id, redacted AS text FROM redacted)', 'second_')}
  SELECT a.doc_id, a.n_matches AS n_first, b.n_matches AS n_second, a.redacted = b.redacted AS is_equal
  FROM redacted a JOIN second_redacted b ON b.doc_id = a.doc_id"""


# --- runs, files -------------------------------------------------------------------

ORACLES["autoredact_stats"] = f"""
  WITH {BADGES}, {ITEMS}
  SELECT (SELECT count(*) FROM documents) AS files_processed, (SELECT count(*) FROM badges) AS badges_generated,
    (SELECT count(*) FROM items) AS new_items_created, (SELECT count(*) FROM items) AS total_items_after"""
ORACLES["output_names"] = rf"""
  SELECT rel_path, regexp_replace(rel_path, '(\.[^./]+)$', '.redacted\1') AS out_path,
    row_number() OVER (ORDER BY string_split(rel_path, '/')) AS path_no
  FROM {d("paths")} p
  WHERE lower(regexp_extract(rel_path, '[^/](\.[^./]+)$', 1))
    IN ('.md', '.markdown', '.txt', '.0', '.asc', '.csv', '.odt', '.rtf')"""
_PAGE_FILES = """
  SELECT concat('p', page_id % 16, CASE page_id % 5 WHEN 0 THEN '/_' WHEN 1 THEN '/.x' ELSE '/' END, page_id, '.md') AS rel_path,
    md5(regexp_replace(html, '\r\n?', chr(10), 'g')) AS text_md5 FROM pages"""
ORACLES["corpus_files"] = _PAGE_FILES
ORACLES["text_files"] = _PAGE_FILES
ORACLES["lenient_decode"] = r"""
  SELECT doc_id, md5(chr(65533) || regexp_replace(text, '\r\n?', chr(10), 'g')) AS text_md5 FROM documents"""
ORACLES["redact_benchmark"] = f"""
  WITH RECURSIVE {DOC_INVENTORY}, {redaction('(SELECT item_id AS doc_id, text FROM benchmark)')}
  SELECT doc_id AS item_id, n_matches, redacted FROM redacted"""
ORACLES["redact_benchmark_large_inventory"] = ORACLES["redact_benchmark"]
ORACLES["redact_null_keys_large_inventory"] = f"""
  {_redact_documents} SELECT CASE WHEN doc_id % 2 = 1 THEN doc_id END AS doc_id, n_matches, redacted FROM redacted"""
ORACLES["redact_empty_inventory"] = "SELECT doc_id, 0::BIGINT AS n_matches, text AS redacted FROM documents"
ORACLES["restore_shared_keys_large_inventory"] = f"SELECT doc_id % 5 AS doc_id, n_tags, restored FROM ({ORACLES['restore_tagged']})"
ORACLES["select_spans_null_key"] = f"SELECT nullif(doc_id, 1) AS doc_id, start, stop FROM ({ORACLES['select_spans']})"
ORACLES["redact_folder"] = f"SELECT doc_id, n_matches FROM ({ORACLES['redact_markdown']})"
ORACLES["redact_folder_files"] = f"SELECT doc_id, redacted FROM ({ORACLES['redact_markdown']})"
ORACLES["restore_folder"] = ORACLES["restore_tagged"]
ORACLES["badge_files"] = f"""
  SELECT kind, code, "desc", surface, count(*) AS n_lines FROM ({ORACLES['badge_parse_arrow']}) GROUP BY ALL"""
ORACLES["validate_badges_job"] = f"""
  SELECT cast(sum(n_valid) AS BIGINT) AS n_valid, cast(sum(n_skipped) AS BIGINT) AS n_skipped FROM ({ORACLES['badge_validate_counts']})"""
ORACLES["autoredact_folder"] = f"SELECT doc_id, redacted FROM ({ORACLES['redact_documents']})"
ORACLES["import_badges_job"] = f"""
  WITH {BADGES}, {ITEMS} SELECT id, code, descr AS "desc", surface, (SELECT count(*) FROM badges) AS n_badges FROM items"""
ORACLES["alias_add_job"] = f"SELECT *, CASE WHEN alias_id > 0 THEN surface END AS stored FROM ({ORACLES['alias_add']})"
