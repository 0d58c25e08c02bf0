from .tables import (EVENT_PANEL_SQL, EVENT_SPEC, SHIP_PANEL_SQL, SHIP_SPEC, event_panel,
                     ship_panel, table)

__all__ = ["EVENT_PANEL_SQL", "EVENT_SPEC", "SHIP_PANEL_SQL", "SHIP_SPEC", "event_panel",
           "ship_panel", "table"]
