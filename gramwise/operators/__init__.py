from gramwise.operators.dedupe import Collection, collected, fold, item_key, keep_last
from gramwise.operators.numbering import numbered
from gramwise.operators.rank import MODES, automatic_mode, badge, display_rows, rank, shown, smart_mode, with_metrics

__all__ = ["Collection", "MODES", "automatic_mode", "badge", "collected", "display_rows", "fold", "item_key", "keep_last", "numbered", "rank", "shown", "smart_mode", "with_metrics"]
