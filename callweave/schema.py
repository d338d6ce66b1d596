"""The relations of the engine; every one has a fixed schema."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "services": "id long, name string, type string, repo_path string, base_url string, primary_language string, last_indexed double",
    "files": "id long, service_id long, path string, absolute_path string, language string, last_modified double, last_indexed double, community_id long, parse_error_count int",
    "symbols": "id long, file_id long, name string, qualified_name string, kind string, line_start int, line_end int, parent_symbol_id long, is_exported boolean, is_entry_point boolean, is_dead boolean, is_test boolean, decorators array<string>, signature string, community_id long",
    "imports": "id long, file_id long, imported_name string, module_path string, resolved_file_id long, resolved_symbol_id long, line int, is_external boolean, original_name string, was_external boolean",
    "calls": "id long, caller_symbol_id long, callee_symbol_id long, callee_name string, file_id long, line int, confidence double, resolution string",
    "heritage": "id long, child_symbol_id long, parent_name string, parent_symbol_id long, kind string",
    "coupling": "id long, file_a_id long, file_b_id long, co_changes int, strength double",
    "flows": "id long, entry_symbol_id long, name string",
    "flow_steps": "id long, flow_id long, symbol_id long, step_order int, depth int",
    "api_endpoints": "id long, service_id long, handler_symbol_id long, method string, path_pattern string, protocol string, file_id long, line int, schema_source string",
    "api_calls": "id long, service_id long, caller_symbol_id long, method string, url_pattern string, protocol string, file_id long, line int, is_dynamic boolean, resolved_endpoint_id long, resolved_service_id long",
    "service_edges": "id long, from_service_id long, to_service_id long, protocol string, call_count int, confidence double",
    "communities": "id long, name string, symbol_count int, internal_edges int, external_edges int, modularity double",
    "rule_violations": "id long, rule_name string, from_file_id long, to_file_id long, from_symbol string, to_symbol string, line int, severity string",
    "symbol_history": "id long, symbol_id long, created_at long, last_modified_at long, modification_count int, author_count int, is_volatile boolean",
    "metadata": "key string, value string",
    "commit_files": "commit string, ts long, path string",
    "blame_lines": "path string, line int, ts long, author string, commit string",
    "file_changes": "ts timestamp, path string, op string, content string",
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[table])
