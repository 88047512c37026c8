"""Static dimensions.

FIXED VALUES: the lists and maps below must equal the source feeds'
conventions for results to match (state names and codes, FIPS codes, area
classes, disease aliases, subtype spellings, NA tokens). They are plain
constants; each is also offered as a small DataFrame for broadcast joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values
# Upper-case state / territory name -> code used by the weekly feed (57 entries).
STATE_CODES: dict[str, str] = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR",
    "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS",
    "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV",
    "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NEW YORK CITY": "NYC", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH",
    "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX",
    "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
    "DISTRICT OF COLUMBIA": "DC", "AMERICAN SAMOA": "AS", "GUAM": "GU",
    "NORTHERN MARIANA ISLANDS": "MP", "PUERTO RICO": "PR", "VIRGIN ISLANDS": "VI",
}

# State code -> two-digit FIPS code (56 entries: 50 states, DC, 5 territories).
STATE_TO_FIPS: dict[str, str] = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08",
    "CT": "09", "DE": "10", "DC": "11", "FL": "12", "GA": "13", "HI": "15",
    "ID": "16", "IL": "17", "IN": "18", "IA": "19", "KS": "20", "KY": "21",
    "LA": "22", "ME": "23", "MD": "24", "MA": "25", "MI": "26", "MN": "27",
    "MS": "28", "MO": "29", "MT": "30", "NE": "31", "NV": "32", "NH": "33",
    "NJ": "34", "NM": "35", "NY": "36", "NC": "37", "ND": "38", "OH": "39",
    "OK": "40", "OR": "41", "PA": "42", "RI": "44", "SC": "45", "SD": "46",
    "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53",
    "WV": "54", "WI": "55", "WY": "56",
    "AS": "60", "GU": "66", "MP": "69", "PR": "72", "VI": "78",
}

# Slugs of reporting areas that are national totals.
NATIONAL_SLUGS = ("us-residents", "usresidents", "non-us-residents", "nonusresidents", "total")

# Slugs of reporting areas that are regional aggregates.
REGION_SLUGS = (
    "new-england", "middle-atlantic", "east-north-central", "west-north-central",
    "south-atlantic", "east-south-central", "west-south-central", "mountain",
    "pacific", "us-territories",
)

# Weekly-feed disease slug -> canonical (state-feed) disease slug.
DISEASE_ALIASES: dict[str, str] = {
    "meningococcal-disease": "meningococcus",
}

# Canonical disease slug -> display name.
DISPLAY_NAMES: dict[str, str] = {
    "measles": "Measles",
    "meningococcus": "Meningococcal Disease",
    "pertussis": "Pertussis",
}

# Weekly-feed label suffixes that are totals, not subtypes (compared lower-case).
AGGREGATE_SUBTYPES = ("all serogroups", "total", "all", "imported", "indigenous")

# Weekly-feed subtype spellings -> canonical subtype (compared lower-case).
WEEKLY_SUBTYPE_NORMALIZATION: dict[str, str] = {
    "other": "unspecified",
    "unknown": "unknown",
}

# State-feed subtype spellings -> canonical subtype (compared lower-case, trimmed).
STATE_SUBTYPE_NORMALIZATION: dict[str, str] = {
    "other": "unspecified",
    "na": "unspecified",
    "not specified": "unspecified",
    "n/a": "unspecified",
}

# State-feed placeholder values that mean "no value" (compared lower-case, trimmed).
PLACEHOLDERS = ("not specified", "unknown", "n/a", "na", "")

# Tokens a CSV reader with default NA handling turns into null (case-sensitive).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Extra NA token of the weekly feed.
WEEKLY_EXTRA_NA = (" ",)

# Default source priority of the monthly merge: first listed wins.
DEFAULT_PRIORITY = ("tracker", "nndss")
# ------------------------------------------------------------ end fixed values


def fips_df(spark: SparkSession) -> DataFrame:
    """(state, fips) dimension, 56 rows — a fixed-size side that is safe to broadcast."""
    return spark.createDataFrame(sorted(STATE_TO_FIPS.items()), "state string, fips string")


def state_codes_df(spark: SparkSession) -> DataFrame:
    """(state_name_upper, state_code) dimension, 57 rows."""
    return spark.createDataFrame(sorted(STATE_CODES.items()), "state_name_upper string, state_code string")
