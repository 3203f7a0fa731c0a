"""SQL fragments shared by oracle queries (DuckDB dialect)."""

from textlake.functions.tokens import TOKEN_PATTERN

def tokens(c: str) -> str:
    return "coalesce(len(regexp_extract_all(" + c + ", '" + TOKEN_PATTERN + "')), 0)"


def terms_sql(c: str) -> str:
    """Folded terms (operators/rerank.terms)."""
    return f"regexp_extract_all({fold_sql(c)}, '[a-z0-9]+')"


def fold_sql(c: str) -> str:
    return "lower(regexp_replace(strip_accents(" + c + r"), '[^\x00-\x7F]', '', 'g'))"


# Gazette-style day index derived from ``orders`` (see sources/gazette.py).
GAZETTE_INDEX = """
SELECT strftime(o_orderdate, '%Y%m%d') AS day_id,
       '/diario_boe/xml.php?id=BOE-' ||
         CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'C' ELSE 'B' END ||
         '-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS url_xml,
       CASE WHEN o_orderpriority LIKE '5%' THEN NULL
            ELSE 'Orden ' || o_orderpriority || ' del cliente ' || CAST(o_custkey AS VARCHAR) END AS title
FROM orders
"""
