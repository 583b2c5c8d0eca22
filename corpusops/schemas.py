"""Fixed schemas of the file inputs and of the chunk table."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


DOC_LINE = T.StructType(
    _strings(
        "chunk_id", "source_url", "source_root", "context", "product", "version", "title",
        "heading_path", "text", "content_hash", "last_modified", "crawl_strategy",
        "_corrupt_record",
    )
)

CHUNK = T.StructType(
    _strings(
        "domain", "chunk_id", "content_hash", "text", "metadata", "context", "product", "version",
        "source_url", "heading_path", "last_modified", "crawl_strategy", "module", "routine_name",
        "file_path",
    )
    + [T.StructField("embedding", T.ArrayType(T.DoubleType())),
       T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)

_LIST = T.ArrayType(T.StringType())

GOLDEN_LINE = T.StructType(
    _strings("id", "query", "domain")
    + [T.StructField("top_k", T.IntegerType())]
    + _strings("priority")
    + [
        T.StructField(
            "filters",
            T.StructType(_strings("context", "product", "version", "module", "routine_name")),
        )
    ]
    + [
        T.StructField(n, _LIST)
        for n in (
            "expected_signals_all", "expected_signals", "expected_signals_any",
            "expected_chunk_ids", "expected_source_urls", "expected_file_paths",
        )
    ]
)

POSITION = T.StructType([T.StructField(n, T.IntegerType()) for n in ("top", "left", "width", "height")])

CHILD = T.StructType(
    _strings("type", "name")
    + [T.StructField("position", POSITION)]
    + _strings("table", "field", "tableField", "caption", "fieldName", "fieldList", "onPrint")
)

BAND = T.StructType(
    _strings("name", "bandType")
    + [T.StructField("tag", T.IntegerType()), T.StructField("canPrint", T.BooleanType())]
    + [T.StructField("tableList", _LIST)]
    + _strings("onBeforePrint", "onAfterPrint")
    + [T.StructField("children", T.ArrayType(CHILD))]
)

BREAK = T.StructType(
    _strings("fieldName", "tableName", "bandName", "footerBandName")
    + [T.StructField("resetPageOnBreak", T.BooleanType()),
       T.StructField("printFooterNewPage", T.BooleanType())]
)

REPORT_MODEL = T.StructType(
    _strings("filename", "version", "caption", "title", "orientation", "reportType", "formatReport")
    + [
        T.StructField("sections", T.MapType(T.StringType(), T.StringType())),
        T.StructField("bands", T.ArrayType(BAND)),
        T.StructField("tablesReferenced", _LIST),
        T.StructField("sqlFragments", _LIST),
        T.StructField("breakList", T.ArrayType(BREAK)),
        T.StructField(
            "_stats",
            T.StructType(
                [T.StructField("parsedBytes", T.LongType()), T.StructField("totalBytes", T.LongType()),
                 T.StructField("parseComplete", T.BooleanType()), T.StructField("bandCount", T.IntegerType()),
                 T.StructField("fieldCount", T.IntegerType()), T.StructField("errorCount", T.IntegerType()),
                 T.StructField("errors", _LIST)]
            ),
        ),
    ]
)
