"""Layout labels: which win over which, and which hold text."""

# Labels by priority, the first that a label occurs at counts.
PRIORITY = (
    "number", "reference", "reference_content", "algorithm", "formula_caption", "isolate_formula", "table_footnote", "table_caption",
    "figure_caption", "figure_title", "chart_title", "table_title", "table_cell_hybrid", "table_text", "wireless_table_cell",
    "wired_table_cell", "abandon", "title", "abstract", "paragraph_title", "content", "doc_title", "footnote", "header", "footer", "seal",
    "plain text", "tiny text", "author_info_hybrid", "list_item_hybrid", "text", "paragraph_hybrid", "paragraph", "table_cell",
    "figure_text", "list_item", "caption", "footnote_hybrid", "formula", "formula_hybrid", "page_header", "page_footer",
    "reference_hybrid", "document_hybrid", "academic_paper_hybrid", "form_or_table_hybrid", "presentation_slide_hybrid",
    "webpage_screenshot_hybrid", "manga_or_comic_hybrid", "advertisement_hybrid", "magazine_or_newspaper_hybrid", "other_hybrid",
    "figure_text_hybrid", "title_hybrid", "caption_hybrid", "code_algo_hybrid", "line_number_hybrid", "page_header_hybrid",
    "page_footer_hybrid", "page_number_hybrid", "unknown_hybrid", "fallback_line", "table", "figure", "image",
)
# Labels whose text is read.
TEXT = frozenset(
    ("plain text", "tiny text", "title", "abandon", "figure_caption", "table_caption", "table_text", "table_footnote", "paragraph_title",
     "abstract", "content", "figure_title", "table_title", "doc_title", "footnote", "header", "footer", "seal", "text", "chart_title",
     "paragraph", "table_cell", "figure_text", "list_item", "caption", "page_header", "page_footer", "wired_table_cell",
     "wireless_table_cell", "paragraph_hybrid", "table_cell_hybrid", "caption_hybrid", "unknown_hybrid", "figure_text_hybrid",
     "list_item_hybrid", "title_hybrid", "fallback_line", "author_info_hybrid", "page_header_hybrid", "page_footer_hybrid",
     "footnote_hybrid")
)


def rank(label: str) -> int:
    """Place in PRIORITY; unknown labels come last."""
    return PRIORITY.index(label) if label in PRIORITY else len(PRIORITY)
