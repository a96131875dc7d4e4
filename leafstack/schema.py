"""Frames that the operators exchange.

``elements``: one row per element of a page. Key (doc_id, page_number, ordinal); ``ordinal`` is the place in the page's
list and the last key of every order, since element ids may repeat inside a page. Metadata that operators read are typed
columns; flags are null where absent. ``crop``: shares cut off a picture at its left, top, right and bottom.
"""

ELEMENTS = (
    "doc_id string, page_number int, ordinal int, element_id string, element_type string, z_order int, "
    "x double, y double, width double, height double, text string, formatted_text string, layout string, source_format string, "
    "is_placeholder boolean, is_heading boolean, heading_level int, is_list_item boolean, list_level int, placeholder_idx int, "
    "image_ref string, image_width int, paragraph_style string, is_mostly_bold boolean, line_pattern string, sheet_name string, col_widths array<double>, row_heights array<double>, crop array<double>, extra map<string,string>"
)
PAGES = "doc_id string, page_number int, width double, height double, source_format string, layout_mode string, sheet_name string"
CELLS = (
    "doc_id string, page_number int, ordinal int, cell_idx int, row_idx int, col_idx int, text string, formatted_text string, "
    "is_spanned boolean, span_width int, span_height int, is_merge_origin boolean, cx double, cy double, cw double, ch double"
)
PAGE = ["doc_id", "page_number"]
KEY = [*PAGE, "ordinal"]
