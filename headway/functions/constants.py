"""Domain constants.

Everything in the FIXED VALUES block below must equal the values the
accuracy service uses, or results change: bins, kinds, route lists, stop
groups and time settings.  They are stated as plain text in their natural
order.  Everything after the block is derived from it.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (must match the service being re-implemented)
# --------------------------------------------------------------------------

TIMEZONE = "America/New_York"

ENVIRONMENTS = ["prod", "dev-green", "dev-blue"]

# bin name -> (lead_min_s, lead_max_s, error_min_s, error_max_s)
BINS = {
    "0-3 min": (-30, 180, -60, 60),
    "3-6 min": (180, 360, -90, 120),
    "6-12 min": (360, 720, -150, 210),
    "12-30 min": (720, 1800, -240, 360),
}

# bins written by older versions and later consolidated
RETIRED_BINS = ["6-8 min", "8-10 min", "10-12 min"]

# arrival/departure uncertainty (s) -> prediction kind
KINDS = {60: "mid_trip", 120: "at_terminal", 360: "reverse"}

SUBWAY_ROUTES = ["Red", "Blue", "Orange", "Green-B", "Green-C", "Green-D", "Green-E", "Mattapan"]

COMMUTER_RAIL_ROUTES = [
    "CR-Fitchburg",
    "CR-Lowell",
    "CR-Haverhill",
    "CR-Newburyport",
    "CR-Worcester",
    "CR-Needham",
    "CR-Franklin",
    "CR-Providence",
    "CR-Fairmount",
    "CR-Middleborough",
    "CR-Kingston",
    "CR-Greenbush",
    "CR-Foxboro",
]

# route-option groups shown in the report form
ROUTE_OPTION_GROUPS = {
    "Green-All": ["Green-B", "Green-C", "Green-D", "Green-E"],
    "Light Rail": ["Green-B", "Green-C", "Green-D", "Green-E", "Mattapan"],
    "Heavy Rail": ["Red", "Orange", "Blue"],
}

# platform-specific terminal stop ids -> generic stop id (subway feeds only)
GENERIC_STOP_IDS = {
    "Alewife-01": "70061",
    "Alewife-02": "70061",
    "Braintree-01": "70105",
    "Braintree-02": "70105",
    "Forest Hills-01": "70001",
    "Forest Hills-02": "70001",
    "Oak Grove-01": "70036",
    "Oak Grove-02": "70036",
}
GENERIC_STOP_PREFIXES = {"Union Square-": "70503"}
# trains incoming at 70511 later show up as stopped at 70512
GENERIC_STOP_RENAMES = {"70511": "70512"}

RED_TRUNK = "70061 70063 70064 70065 70066 70067 70068 70069 70070 70071 70072 70073 70074 70075 70076 70077 70078 70079 70080 70081 70082 70083 70084".split()
ASHMONT_BRANCH = "70085 70086 70087 70088 70089 70090 70091 70092 70093 70094".split()
BRAINTREE_BRANCH = "70095 70096 70097 70098 70099 70100 70101 70102 70103 70104 70105".split()
GREEN_TRUNK = "70150 70151 70152 70153 70154 70155 70156 70157 70158 70159 70196 70197 70198 70199 70200 70201 70202 70203 70204 70205 70206 71150 71151 71199".split()
B_BRANCH = "70106 70107 70110 70111 70112 70113 70114 70115 70116 70117 70120 70121 70124 70125 70126 70127 70128 70129 70130 70131 70134 70135 70136 70137 70138 70139 70140 70141 70142 70143 70144 70145 70146 70147 70148 70149".split()
C_BRANCH = "70211 70212 70213 70214 70215 70216 70217 70218 70219 70220 70223 70224 70225 70226 70227 70228 70229 70230 70231 70232 70233 70234 70235 70236 70237 70238".split()
D_BRANCH = "70160 70161 70162 70163 70164 70165 70166 70167 70168 70169 70170 70171 70172 70173 70174 70175 70176 70177 70178 70179 70180 70181 70182 70183 70186 70187".split()
E_BRANCH = "70239 70240 70241 70242 70243 70244 70245 70246 70247 70248 70249 70250 70251 70252 70253 70254 70255 70256 70257 70258 70260".split()
TERMINALS = "70001 70036 70038 70059 70061 70094 70105 70106 70160 70161 70196 70197 70198 70199 70201 70202 70205 70206 70238 70260 70261 70276 71199 70503".split()
NEAR_TERMINALS_BY_LINE = {
    "blue": "70038 70040 70042 70044 70053 70055 70057 70059".split(),
    "green_b": "70106 70110 70112 70114".split(),
    "green_c": "70232 70234 70236 70238".split(),
    "green_d": "70160 70162 70164 70166".split(),
    "green_e": "70260 70254 70256 70258".split(),
    "green_trunk": "70155 70157 70159 70196 70197 70198 70199 70202 70204 70206".split(),
    "mattapan": "70261 70263 70265 70267 70270 70272 70274 70276".split(),
    "orange": "70001 70003 70005 70007 70032 70034 70036 70278".split(),
    "red_ashmont": "70088 70090 70092 70094".split(),
    "red_braintree": "70100 70102 70104 70105".split(),
    "red_trunk": "70061 70063 70065 70067".split(),
}

# group id -> (display name, member stops)
STOP_GROUPS = {
    "_trunk": ("Trunk stops", RED_TRUNK + GREEN_TRUNK),
    "_branch": (
        "Branch stops",
        ASHMONT_BRANCH + BRAINTREE_BRANCH + B_BRANCH + C_BRANCH + D_BRANCH + E_BRANCH,
    ),
    "_terminal": ("Terminals", TERMINALS),
    "_near_terminal": (
        "Terminals + next 3 stops",
        [s for line in NEAR_TERMINALS_BY_LINE.values() for s in line],
    ),
    "_ashmont_branch": ("Red Line - Ashmont branch", ASHMONT_BRANCH),
    "_braintree_branch": ("Red Line - Braintree branch", BRAINTREE_BRANCH),
}

MAX_DWELL_S = 30 * 60
MATTAPAN_MAX_DWELL_S = 20 * 60
PRUNE_LOOKBACK_S = 7 * 24 * 60 * 60
ANALYSIS_LOOKBACK_MIN = 40

STANDARD_MATCH_WINDOW_S = 30 * 60  # predictions with a vehicle id: file_ts > now - 30 min
TERMINAL_MATCH_WINDOW_S = 40 * 60  # predictions without a vehicle id: file_ts >= now - 40 min

DROP_THRESHOLD = 0.1
MAX_DAILY_RANGE_DAYS = 35

STATUS_STOPPED = "STOPPED_AT"
VEHICLE_STATUSES = ["INCOMING_AT", "IN_TRANSIT_TO", "STOPPED_AT"]

CSV_HEADER_TAIL = ["Prod Accuracy", "Err", "RMSE", "Count"]

# --------------------------------------------------------------------------
# derived values
# --------------------------------------------------------------------------

BLOCK_S = 300
# a block is scored 30 s after the 5-minute mark that follows block_start + 40 min
VISIBILITY_LAG_S = ANALYSIS_LOOKBACK_MIN * 60 + 30
KIND_VALUES = list(KINDS.values())
BIN_NAMES = list(BINS)
ALL_ROUTES = SUBWAY_ROUTES + COMMUTER_RAIL_ROUTES
ROUTE_RANK = {r: i for i, r in enumerate(SUBWAY_ROUTES)}


def routes_for_mode(mode: str | None) -> list[str]:
    """Any mode string other than 'commuter_rail' means subway."""
    return COMMUTER_RAIL_ROUTES if mode == "commuter_rail" else SUBWAY_ROUTES


def expand_stop_groups(ids: list[str]) -> list[str]:
    """Replace each group id by its members; other ids pass through."""
    out: list[str] = []
    for i in ids:
        out.extend(STOP_GROUPS[i][1] if i in STOP_GROUPS else [i])
    return out


def max_dwell_for_route(route_id: str | None) -> int:
    return MATTAPAN_MAX_DWELL_S if route_id == "Mattapan" else MAX_DWELL_S
