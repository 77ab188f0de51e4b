"""The tables' types and natural keys."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "d": T.DoubleType(), "S": T.ArrayType(T.StringType()), "F": T.ArrayType(T.FloatType()), "I": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(x.split(":")[0], kinds[x.split(":")[1]]) for x in ddl.split()])


SCHEMAS = {
    "files": _schema("id:l path:s hash:s mtime:l size:l language:s parsed_at:l"),
    "symbols": _schema("id:l file_id:l name:s kind:s start_line:i end_line:i exported:b complexity:l docstring:s"),
    "imports": _schema("id:l file_id:l source:s resolved_file_id:l resolved:b external:b static:b"),
    "edges": _schema("from_symbol_id:l to_symbol_id:l kind:s"),
    "requirement_code_links": _schema("symbol_id:l req_id:s"),
    "cache": _schema("key:s content:s hash:s version:l confidence:d size:l updated_at:l last_access:l"),
    "health_signals": _schema("key:s value:d source:s updated_at:l"),
    "sql_queries": _schema("id:l query_text:s file_id:l"),
    "query_tables": _schema("query_id:l table_name:s"),
    "commits": _schema("sha:s message:s author:s author_date:s committer_date:s insertions:l deletions:l parent_sha:s commit_type:s seq:l"),
    "commit_files": _schema("commit_sha:s file_id:l"),
    "entities": _schema("id:s type:s name:s content:s commit_sha:s tags:S created_at:s last_seen:s"),
    "postings": _schema("term:s id:s positions:I"),
    "posting_lengths": _schema("id:s len:l"),
    "entity_symbols": _schema("entity_id:s symbol_id:l"),
    "backlinks": _schema("from_id:s to_id:s relationship:s context:s"),
    "embeddings": _schema("kind:s doc_id:s hash:s model:s dim:i source_path:s embedded_at:l label:s snippet:s embedding:F"),
    "requirements": _schema("id:s title:s description:s source:s status:s"),
    "atomic_requirements": _schema("req_id:s statement:s type:s order:i"),
}
KEYS = {
    "files": ["path"], "symbols": ["id"], "imports": ["id"], "edges": ["from_symbol_id", "to_symbol_id", "kind"], "requirement_code_links": ["symbol_id", "req_id"],
    "cache": ["key"], "health_signals": ["key"], "sql_queries": ["id"], "query_tables": ["query_id", "table_name"], "commits": ["sha"], "commit_files": ["commit_sha", "file_id"],
    "entities": ["id"], "postings": ["term", "id"], "posting_lengths": ["id"], "entity_symbols": ["entity_id", "symbol_id"], "backlinks": ["from_id", "to_id", "relationship"], "embeddings": ["kind", "doc_id"],
    "requirements": ["id"], "atomic_requirements": ["req_id", "order"],
}
