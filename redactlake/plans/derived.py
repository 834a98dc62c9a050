"""Inputs the tables do not hold as such, written once in SQL both Spark and DuckDB read.

Each value is a SELECT over the given tables, named in braces.
"""

from __future__ import annotations

NL = "chr(10)"
FENCE = "'```'"

_CODE = (
    "concat('(', cast(1 + {k} % 5 as varchar(9)), ')(', substr('ABCDEXZ', cast(1 + {n} % 7 as int), 1), ')', "
    "case when {n} % 3 = 0 then concat('(', substr('abcdexf', cast(1 + {k} % 7 as int), 1), ')') else '' end)"
)


def code(k: str, n: str) -> str:
    """A classification code made of two keys; some are outside the legend."""
    return _CODE.format(k=k, n=n)


def good_code(k: str) -> str:
    return f"concat('(', cast(1 + {k} % 4 as varchar(9)), ')(', substr('ABCDEX', cast(1 + {k} % 6 as int), 1), ')')"


DERIVED: dict[str, str] = {
    "arrow_lines": f"""
        SELECT c_nationkey AS src, c_custkey AS line_no,
          CASE c_custkey % 13
            WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN concat('# ', c_name) WHEN 3 THEN concat('  # ', c_name)
            WHEN 4 THEN concat('[REDACTED ', c_name, '] => x')
            ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE '' END,
              '[REDACTED: ', {code('c_nationkey', 'c_custkey')}, ' , ', c_mktsegment, ', the name ] =>  ', c_name,
              ' | ', c_mktsegment, '  ')
          END AS raw
        FROM {{customer}}""",
    "pipe_lines": f"""
        SELECT s_nationkey AS src, s_suppkey AS line_no,
          CASE s_suppkey % 11
            WHEN 0 THEN concat('#', s_name) WHEN 1 THEN concat({code('s_nationkey', 's_suppkey')}, ' | only two')
            ELSE concat({code('s_nationkey', 's_suppkey')}, '|  partner ] name |', s_name, ' | tail => ', s_name, ' ')
          END AS raw
        FROM {{supplier}}""",
    "codes": f"SELECT c_custkey, {code('c_nationkey', 'c_custkey')} AS code FROM {{customer}}",
    "customer_items": f"""
        SELECT c_custkey AS item_pos, c_custkey + 1 AS id, {good_code('c_custkey')} AS code,
          concat('customer, ', c_mktsegment) AS descr, c_name AS surface, 'global' AS scope
        FROM {{customer}}""",
    "customer_aliases": """
        SELECT c_custkey AS item_pos, c_custkey + 1 AS item_id, cast(0 as bigint) AS alias_pos, cast(1 as bigint) AS alias_id,
          upper(c_name) AS surface FROM {customer}
        UNION ALL
        SELECT c_custkey, c_custkey + 1, cast(1 as bigint), cast(2 as bigint), replace(c_name, '#', ' no. ') FROM {customer}
        WHERE c_acctbal > 0""",
    "supplier_items": f"""
        SELECT s_suppkey AS item_pos, s_suppkey + 1 AS id, {good_code('s_nationkey')} AS code,
          concat('partner ', cast(s_suppkey % 3 as varchar(9))) AS descr, s_name AS surface, 'global' AS scope
        FROM {{supplier}}""",
    "supplier_aliases": """
        SELECT s_suppkey AS item_pos, s_suppkey + 1 AS item_id, cast(0 as bigint) AS alias_pos, cast(1 as bigint) AS alias_id,
          concat('nation ', cast(s_nationkey as varchar(9))) AS surface FROM {supplier}""",
    "customer_badges": f"""
        SELECT c_custkey AS ord, {good_code('c_nationkey')} AS code,
          concat('partner ', cast(c_custkey % 4 as varchar(9))) AS descr,
          CASE c_custkey % 3
            WHEN 0 THEN replace(c_name, 'Customer', 'Supplier')
            WHEN 1 THEN concat('nation ', cast(c_nationkey as varchar(9)))
            ELSE concat('  ', c_mktsegment, ' ', cast(c_nationkey as varchar(9)), ' ')
          END AS surface
        FROM {{customer}}""",
    "alias_requests": """
        SELECT o_orderkey AS ord, o_custkey + 1 AS item_id,
          CASE o_orderkey % 4
            WHEN 0 THEN concat('Customer#', lpad(cast(o_custkey as varchar(20)), 9, '0'))
            WHEN 1 THEN concat(' CUSTOMER#', lpad(cast(o_custkey as varchar(20)), 9, '0'))
            WHEN 2 THEN concat('account ', cast(o_custkey as varchar(20)))
            ELSE concat(o_orderpriority, ' ', cast(o_custkey as varchar(20)))
          END AS surface
        FROM {orders}""",
    "alias_keys": "SELECT o_orderkey, o_custkey * 2 AS item_id, cast(o_orderkey % 4 as bigint) AS alias_id FROM {orders}",
    "equal_items": f"""
        SELECT c_custkey AS item_pos, c_custkey + 1 AS id, {good_code('c_custkey')} AS code, c_mktsegment AS descr,
          concat(c_mktsegment, ' ', cast(c_nationkey as varchar(9))) AS surface, 'global' AS scope FROM {{customer}}""",
    "equal_aliases": """
        SELECT c_custkey AS item_pos, c_custkey + 1 AS item_id, cast(0 as bigint) AS alias_pos, cast(1 as bigint) AS alias_id,
          c_mktsegment AS surface FROM {customer}
        UNION ALL
        SELECT c_custkey, c_custkey + 1, cast(1 as bigint), cast(2 as bigint), concat('BUILDING ', cast(c_nationkey as varchar(9)))
        FROM {customer}""",
    "markdown": f"""
        SELECT c_custkey AS doc_id,
          concat('Order ', c_name, ' and ', upper(c_name), {NL},
            CASE c_custkey % 5
              WHEN 0 THEN concat({FENCE}, 'txt', {NL}, c_name, {NL}, {FENCE}, {NL})
              WHEN 1 THEN concat({FENCE}, {NL}, c_name, {NL}, {FENCE}, ' ', {NL}, 'open ', c_name, {NL})
              WHEN 2 THEN concat('`', {FENCE}, 'x', {NL}, {FENCE}, {NL}, 'é', c_name, {NL}, {FENCE}, {NL}, upper(c_name), {NL}, {FENCE}, {NL})
              WHEN 3 THEN concat('[REDACTED(#', cast(c_custkey + 1 as varchar(20)), '|var=c): (1)(A), ', c_name, ']', {NL}, '[REDACTED(#', {NL})
              ELSE ''
            END, 'Ship to ', replace(c_name, '#', ' no. '), c_name, ', ', c_mktsegment) AS text
        FROM {{customer}}""",
    "tagged": f"""
        SELECT o_orderkey AS doc_id,
          concat('Order of [REDACTED(#', cast(o_custkey * 2 as varchar(20)), '|var=c): (1)(A), customer, ', o_orderpriority, ']', {NL},
            {FENCE}, {NL}, 'in a fence [REDACTED(#', cast(o_custkey as varchar(20)), '|var=a', cast(o_orderkey % 4 as varchar(20)), '):', {NL},
            ' (2)(B),', {NL}, 'x', {NL}, ']', {NL}, {FENCE}, {NL},
            CASE WHEN o_orderkey % 3 = 0 THEN '[REDACTED(#7|var=b): a, b] [REDACTED(#07|var=a01): a, b]' ELSE 'end' END) AS text
        FROM {{orders}}""",
    "spans": """
        SELECT DISTINCT l_suppkey AS doc_id, l_orderkey AS start, l_orderkey + cast(l_quantity as bigint) AS stop FROM {lineitem}""",
    "hosts": """
        SELECT min(page_id) AS item_pos, host FROM (
          SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM {pages}) w
        WHERE host <> '' GROUP BY host""",
    "paths": """
        SELECT page_id, concat(regexp_extract(url, '://([^/]+)', 1), CASE page_id % 4 WHEN 0 THEN '-x' WHEN 1 THEN '.d' ELSE '' END,
          '/p', cast(page_id as varchar(20)),
          CASE page_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.tar.MD' WHEN 2 THEN '.html' WHEN 3 THEN '' WHEN 4 THEN '/.md'
            WHEN 5 THEN '.markdown' ELSE '.Csv' END) AS rel_path
        FROM {pages}""",
}


def for_duckdb(name: str) -> str:
    """The SELECT with plain table names."""
    return "(" + _bind(name, lambda t: t) + ")"


def tables_of(name: str) -> list[str]:
    found: list[str] = []
    _bind(name, lambda t: found.append(t) or t)
    return sorted(set(found))


def _bind(name: str, table) -> str:
    class Names(dict):
        def __missing__(self, key):
            return table(key)

    return DERIVED[name].format_map(Names())
