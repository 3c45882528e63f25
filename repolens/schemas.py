"""Explicit schemas of the model tables."""

PROJECTS = "project_id bigint, name string, root_path string, created_at timestamp, updated_at timestamp, graph_built_at timestamp"
FILES = "file_id bigint, project string, path string, language string, size_bytes bigint, mtime timestamp, hash string, content string"
CHUNKS = "file_id bigint, project string, path string, chunk_id bigint, start_line int, end_line int, content string, token_estimate bigint, kind string"
NODES = "node_id bigint, type string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string"
EDGES = "edge_id bigint, from_id bigint, to_id bigint, type string, confidence double, raw string"
USAGE = "usage_id bigint, tool string, project string, called_at timestamp, tokens_without bigint, tokens_actual bigint"
SYMBOLS = "project string, path string, name string, kind string, line_no int, signature string"
IMPORTS = "project string, path string, imported_path string"
