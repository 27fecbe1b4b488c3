"""Hand-written golden inputs (nested records, payloads) shared by tests."""

import json

REPLY_TEXT = "good\nnn av ok"

RECORD_AV1 = {
    "av": "av1",
    "bullet_screen": [
        {"p": 1, "cid": 11, "part": "one",
         "bullet": {"s1": {"1577836800": "good show, good", "1577836801": '[1,2,"x"]'},
                    "s2": {"1577837100": "bad [end]"}}},
        {"p": 2, "cid": 12, "part": "two", "bullet": {}},
    ],
    "replies": [
        {"time": 1577837099, "name": "n", "sex": "x", "like": 3, "level": 4, "message": REPLY_TEXT},
        {"time": 1577837100, "name": "m", "sex": "y", "like": 0, "level": 1, "message": "a"},
    ],
}
RECORD_AV2 = {"av": "av2", "bullet_screen": [], "replies": []}

RAW_LINES = [json.dumps(RECORD_AV1), json.dumps(RECORD_AV2), "{}", "{bad"]
