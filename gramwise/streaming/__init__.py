from gramwise.streaming.buckets import buckets_of, tasks_of
from gramwise.streaming.collect import Session, collect_stream, collections, display, look_stream, looked, screen_items, seen, with_ends
from gramwise.streaming.sessions import debounced, package_sessions, passive_scans, scan_all_stops, stop_of_scan_all

__all__ = ["Session", "buckets_of", "collect_stream", "collections", "debounced", "display", "look_stream", "looked", "package_sessions", "passive_scans", "scan_all_stops", "screen_items", "seen", "stop_of_scan_all", "tasks_of", "with_ends"]
