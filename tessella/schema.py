"""Columns of the index tables. Every stored table carries schema_version; another version counts as absent."""

from __future__ import annotations

TABLES = {
    "files": "rel string, module string, kind string, lang string, title string, summary string, symbols bigint, lines bigint, deg_in bigint, deg_out bigint, test_file boolean, hash string, size bigint, mtime double",
    "modules": "slug string, path string, title string, summary string, tier int, members array<string>, symbols bigint, lines bigint, deg_in bigint, deg_out bigint, pagerank double, betweenness double, community int, tested_by array<string>",
    "file_edges": "src string, dst string, kind string, weight bigint, confidence string, dangling boolean, reason string",
    "module_edges": "src string, dst string, kind string, weight bigint",
    "surprises": "src string, dst string, kind string, weight bigint, c_src int, c_dst int, pair_edges bigint",
    "defs": "name string, file string, line int, end_line int, kind string, exported boolean, lang string, parent string",
    "refs": "name string, file string",
    "prose": "slug string, digest string, source string, baselined boolean",
    "cache": "rel string, hash string, size bigint, mtime double, kind string, record string",
    "partial": "max_files bigint, left_out bigint",
    "vectors": "slug string, hash string, v array<tinyint>, model string, dim int",
    "vocabulary": "model string, dim int, token string, weights array<double>",
}
