"""Column functions on clocks, spots, teams and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Team codes as printed -> as used; the 32 teams by code.
ALIASES = {"ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU", "LA": "LAR", "JAC": "JAX", "WSH": "WAS"}
TEAMS = {
    "ARI": "Arizona Cardinals", "ATL": "Atlanta Falcons", "BAL": "Baltimore Ravens", "BUF": "Buffalo Bills",
    "CAR": "Carolina Panthers", "CHI": "Chicago Bears", "CIN": "Cincinnati Bengals", "CLE": "Cleveland Browns",
    "DAL": "Dallas Cowboys", "DEN": "Denver Broncos", "DET": "Detroit Lions", "GB": "Green Bay Packers",
    "HOU": "Houston Texans", "IND": "Indianapolis Colts", "JAX": "Jacksonville Jaguars", "KC": "Kansas City Chiefs",
    "LAC": "Los Angeles Chargers", "LAR": "Los Angeles Rams", "LV": "Las Vegas Raiders", "MIA": "Miami Dolphins",
    "MIN": "Minnesota Vikings", "NE": "New England Patriots", "NO": "New Orleans Saints", "NYG": "New York Giants",
    "NYJ": "New York Jets", "PHI": "Philadelphia Eagles", "PIT": "Pittsburgh Steelers", "SEA": "Seattle Seahawks",
    "SF": "San Francisco 49ers", "TB": "Tampa Bay Buccaneers", "TEN": "Tennessee Titans", "WAS": "Washington Commanders",
}
COLOURS = {
    "ARI": "#97233f", "ATL": "#a71930", "BAL": "#4f2683", "BUF": "#00338d", "CAR": "#0085ca", "CHI": "#c83803", "CIN": "#fb4f14",
    "CLE": "#ff3c00", "DAL": "#4f6d8a", "DEN": "#fb4f14", "DET": "#0076b6", "GB": "#1f5a43", "HOU": "#03202f", "IND": "#2f6da3",
    "JAX": "#0080a0", "KC": "#e31837", "LV": "#7a7d80", "LAC": "#0080c6", "LAR": "#3158a6", "MIA": "#008e97", "MIN": "#4f2683",
    "NE": "#c83943", "NO": "#b2955a", "NYG": "#0b4aa2", "NYJ": "#34715a", "PHI": "#267269", "PIT": "#c8a932", "SF": "#aa0000",
    "SEA": "#4b9658", "TB": "#b13a32", "TEN": "#4b92db", "WAS": "#8f2635", "visitor": "#3f7fa8", "home": "#c34b4b",
}
GROUPS = ("QB", "RB / FB", "WR", "TE", "OL", "DL", "LB", "DB", "SPECIALISTS", "OTHER")
POSITION_GROUPS = {
    "QB": "QB", "RB": "RB / FB", "FB": "RB / FB", "WR": "WR", "TE": "TE", "C": "OL", "G": "OL", "T": "OL", "OL": "OL", "LT": "OL",
    "LG": "OL", "RG": "OL", "RT": "OL", "DL": "DL", "DE": "DL", "DT": "DL", "NT": "DL", "LB": "LB", "ILB": "LB",
    "OLB": "LB", "CB": "DB", "DB": "DB", "S": "DB", "FS": "DB", "SS": "DB", "K": "SPECIALISTS", "P": "SPECIALISTS", "LS": "SPECIALISTS",
}
RESULT_CODES = {
    "Touchdown": "TD", "Field Goal": "FG", "Punt": "P", "Interception": "INT", "Fumble": "FUM", "Downs": "DN",
    "Missed FG": "MFG", "End of Game": "END", "In Progress": "LIVE",
}


def lookup(values: dict[str, str], key: Column) -> Column:
    """A small dictionary as a literal map; null where the key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def norm_team_code(code: Column) -> Column:
    c = F.upper(F.trim(code))
    return F.coalesce(lookup(ALIASES, c), c)


def normal_clock(clock: Column) -> Column:
    return F.when(clock.startswith(":"), F.concat(F.lit("0"), clock)).otherwise(clock)


def clock_seconds(clock: Column) -> Column:
    parts = F.split(normal_clock(clock), ":")
    return (F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")).cast("int")


def spot_parts(spot: Column) -> tuple[Column, Column]:
    """(normal team code or null, yard) of a printed spot; the bare 50 has no team."""
    code = F.nullif(F.regexp_extract(spot, r"^\s*([A-Za-z]{2,3}) +\d+\s*$", 1), F.lit(""))
    return norm_team_code(code), F.regexp_substr(spot, F.lit(r"\d+")).try_cast("int")


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def absolute_yard(spot: Column, visitor: Column, home: Column) -> Column:
    """0 at the visitor's goal, 100 at the home team's; null for an unknown code."""
    code, yard = spot_parts(spot)
    near = clamp(yard, 0, 50)
    return F.when(F.trim(spot) == "50", 50).when(code == visitor, near).when(code == home, 100 - near).cast("int")


def field_position(spot: Column, possession: Column) -> Column:
    """Yards from the possessing team's own goal; another or unknown code counts from the far side."""
    code, yard = spot_parts(spot)
    return F.when(F.trim(spot) == "50", 50).when(code == norm_team_code(possession), yard).otherwise(100 - yard).cast("int")


def field_percent(yard: Column) -> Column:
    return 10 + clamp(yard) * 0.8


def attack_direction(possession: Column, visitor: Column, home: Column) -> Column:
    return F.when(possession == visitor, "right").when(possession == home, "left").otherwise("unknown")


def down_label(down: Column, distance: Column, is_goal: Column) -> Column:
    suffix = F.coalesce(F.get(F.array(*[F.lit(x) for x in ("TH", "ST", "ND", "RD")]), down), F.lit("TH"))
    return F.concat(down.cast("string"), suffix, F.lit(" & "), F.when(is_goal, F.lit("Goal")).otherwise(distance.cast("string")))


def quarter_label(quarter: Column) -> Column:
    return F.when(quarter >= 5, F.lit("OT")).otherwise(F.concat(F.lit("Q"), quarter.cast("string")))


def position_group(position: Column) -> Column:
    return F.coalesce(lookup(POSITION_GROUPS, position), F.lit("OTHER"))


def group_rank(position: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GROUPS]), position_group(position))


def result_code(result: Column) -> Column:
    """A drive's result in short; of one that has no code the first three letters."""
    return F.coalesce(lookup(RESULT_CODES, result), F.upper(F.substring(result, 1, 3)))


def leading_number(text: Column) -> Column:
    return F.regexp_substr(text, F.lit(r"^\s*[-+]?\d*\.?\d+")).try_cast("double")
