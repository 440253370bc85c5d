from .tables import (read_table, term_log, search_events, requests,
                     request_log, keystrokes, event_json)
