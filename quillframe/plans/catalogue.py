"""All driver queries of the engine and their DuckDB SQL."""

from quillframe.plans import file_queries, fold_queries, glyph_queries, layout_queries, page_queries, part_queries, render_queries, service_queries, style_queries, text_queries

_MODULES = (layout_queries, glyph_queries, style_queries, text_queries, page_queries, part_queries, render_queries, service_queries, fold_queries, file_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
