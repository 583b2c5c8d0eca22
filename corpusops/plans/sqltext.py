"""Shared pieces of the comparison SQL."""

SPACE = (
    r"[\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean_sql(x: str) -> str:
    y = f"regexp_replace(coalesce({x}, ''), '\\r', '', 'g')"
    y = f"regexp_replace({y}, '[ \\t]+\\n', chr(10), 'g')"
    y = f"regexp_replace({y}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    y = f"regexp_replace({y}, '[ \\t]{{2,}}', ' ', 'g')"
    return trim_sql(y)


def words_sql(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    )


CHUNKS = """chunks AS (
  SELECT 'docs' AS domain, CAST(doc_id AS VARCHAR) AS chunk_id, lang AS context, source AS product, text
  FROM documents)"""
