from gramwise.sources.listings import crowded_nodes, dealt, files_of, in_batches, listings, ocr_lines, recorded, scan_all_events, scan_events, scan_sizes, screen_nodes, screens, table, wide_nodes
from gramwise.sources.screen import best_scrollable, drop_noise, node_candidates, node_items, ocr_candidates, ocr_context, ocr_items
from gramwise.sources.texts import analysed

__all__ = ["analysed", "best_scrollable", "crowded_nodes", "dealt", "drop_noise", "files_of", "in_batches", "listings", "node_candidates", "node_items", "ocr_candidates", "ocr_context", "ocr_items", "ocr_lines", "recorded", "scan_all_events", "scan_events", "scan_sizes", "screen_nodes", "screens", "table", "wide_nodes"]
