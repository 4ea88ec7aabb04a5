"""Units, thresholds, code tables and regions of the data model."""

# Units and physical constants.
KNOTS_TO_KMH = 1.852
NM_TO_KM = 1.852
EARTH_RADIUS_KM = 6371.0
PLANAR_KM_PER_DEG = 111.322
CHORD_KM_PER_DEG = 111.32
SPAN_KM_PER_DEG = 111.0
MERCATOR_RADIUS_M = 6378137.0

# Cleaning and segmentation limits.
MAX_SOG_KNOTS = 102.2
HEADING_MISSING = 511
MAX_GAP_HOURS = 6.0
MAX_SPEED_KMH = 50.0 * KNOTS_TO_KMH
MIN_POINTS = 50
MIN_SEGMENT_HOURS = 12.0
MIN_DISTANCE_KM = 10.0 * KNOTS_TO_KMH

# Window task (24 h of history, 12 h of future, 10-minute grid).
HISTORY_HOURS = 24.0
FUTURE_HOURS = 12.0
RESAMPLE_MINUTES = 10
MAX_GAP_STEPS = 6
MAX_WINDOWS_PER_TRAJECTORY = 200
EXPECTED_HISTORY_STEPS = 144
EXPECTED_FUTURE_STEPS = 72
MIN_NORMALIZE_KM = 10.0

# The fifteen features of one history step, in storage order.
FEATURES = (
    "lat",
    "lon",
    "sog",
    "cog_sin",
    "cog_cos",
    "heading_sin",
    "heading_cos",
    "heading_missing",
    "dt_sec",
    "dlat",
    "dlon",
    "dsog",
    "dcog",
    "v_north_kmh",
    "v_east_kmh",
)
TARGETS = ("lat", "lon")
# Old column names accepted for a feature.
FEATURE_ALIASES = {"v_north_kmh": "v_north_knots", "v_east_kmh": "v_east_knots"}

# Ship types kept by the commercial filter.
COMMERCIAL_SHIP_TYPES = (
    "Cargo",
    "Tanker",
    "Passenger",
    "Towing",
    "Tug",
    "Port tender",
    "Dredging",
)
COMMERCIAL_CODE_RANGES = ((30, 39), (50, 89))

# Vessel classes by code range (0 = unknown, 8 = any other code).
VESSEL_CLASS_NAMES = {
    0: "unknown",
    1: "passenger",
    2: "cargo",
    3: "tanker",
    4: "service",
    5: "fishing",
    6: "misc",
    7: "hsc",
    8: "other",
}
VESSEL_CLASS_RANGES = (
    (60, 69, 1),
    (70, 79, 2),
    (80, 89, 3),
    (50, 59, 4),
    (30, 39, 5),
    (20, 29, 6),
    (40, 49, 7),
)

# Display labels by exact code, then by range.
VESSEL_LABELS = {
    30: "Fishing",
    31: "Towing",
    32: "Towing (large)",
    33: "Dredging",
    34: "Diving",
    35: "Military",
    36: "Sailing",
    37: "Pleasure craft",
    50: "Pilot",
    51: "SAR",
    52: "Tug",
    53: "Port tender",
    54: "Pollution control",
    55: "Law enforcement",
    58: "Medical",
    59: "Special craft",
    60: "Passenger",
    70: "Cargo",
    80: "Tanker",
}
VESSEL_LABEL_RANGES = (
    (60, 69, "Passenger"),
    (70, 79, "Cargo"),
    (80, 89, "Tanker"),
    (30, 39, "Special / fishing"),
    (50, 59, "Special craft"),
)

# Region boxes as (lat_min, lat_max, lon_min, lon_max).
REGIONS = {
    "usa_combined": (14.0, 50.0, -130.0, -60.0),
    "west_coast": (32.0, 49.5, -126.0, -117.0),
    "california": (32.0, 38.5, -124.5, -117.0),
    "pnw": (45.0, 49.5, -126.0, -122.0),
    "mexican_coast": (14.0, 32.5, -118.0, -86.0),
    "mexico_pacific": (14.0, 32.5, -118.0, -105.0),
    "mexico_gulf": (18.0, 26.5, -98.0, -86.0),
    "gulf": (24.0, 31.0, -98.0, -80.0),
    "east_coast": (35.0, 43.5, -76.5, -68.0),
    "danish": (54.5, 58.0, 7.5, 13.0),
}

# Coast folder name -> region its datasets should carry.
COAST_REGION = {
    "West Coast": "west_coast",
    "Mexcany Beach": "mexican_coast",
    "Eastern coast": "east_coast",
}

# Ports as (name, lon, lat) by region.
PORTS = {
    "danish": (
        ("Copenhagen", 12.5683, 55.6761),
        ("Aarhus", 10.2167, 56.1500),
        ("Aalborg", 9.9217, 57.0488),
        ("Fredericia", 9.7522, 55.5658),
        ("Esbjerg", 8.4500, 55.4667),
        ("Helsingør", 12.6136, 56.0361),
        ("Kalundborg", 11.0886, 55.6794),
        ("Frederikshavn", 10.5361, 57.4417),
        ("Skagen", 10.5950, 57.7208),
        ("Hanstholm", 8.6167, 57.1167),
        ("Korsør", 11.1386, 55.3294),
        ("Nyborg", 10.7897, 55.3125),
        ("Gedser", 11.9258, 54.5758),
        ("Rønne", 14.7014, 55.1011),
    ),
    "east_coast": (
        ("New York", -74.0060, 40.7128),
        ("Boston", -71.0589, 42.3601),
        ("Philadelphia", -75.1652, 39.9526),
        ("Baltimore", -76.6122, 39.2904),
        ("Norfolk", -76.2859, 36.8508),
        ("Providence", -71.4128, 41.8240),
        ("Portland ME", -70.2568, 43.6591),
        ("New Haven", -72.9279, 41.3083),
    ),
    "gulf": (
        ("Houston", -95.0195, 29.7290),
        ("New Orleans", -90.0640, 29.9360),
        ("Tampa", -82.4510, 27.9230),
        ("Mobile", -88.0399, 30.6954),
        ("Galveston", -94.7930, 29.3110),
        ("Corpus Christi", -97.3964, 27.8006),
        ("Pascagoula", -88.5561, 30.3658),
    ),
    "california": (
        ("Los Angeles", -118.2720, 33.7405),
        ("Long Beach", -118.1937, 33.7540),
        ("Oakland", -122.3000, 37.7950),
        ("San Francisco", -122.4194, 37.7749),
        ("San Diego", -117.1730, 32.7100),
        ("Stockton", -121.2900, 37.9570),
    ),
    "west_coast": (
        ("San Diego", -117.1730, 32.7100),
        ("Los Angeles", -118.2720, 33.7405),
        ("Long Beach", -118.1937, 33.7540),
        ("San Francisco", -122.4194, 37.7749),
        ("Oakland", -122.3000, 37.7950),
        ("Seattle", -122.3380, 47.6062),
        ("Tacoma", -122.4443, 47.2529),
        ("Portland", -122.6750, 45.5231),
    ),
    "mexican_coast": (
        ("Ensenada", -116.6320, 31.8660),
        ("La Paz", -110.3090, 24.1420),
        ("Mazatlán", -106.4160, 23.1950),
        ("Manzanillo", -104.3350, 19.0520),
        ("Lázaro Cárdenas", -102.1950, 17.9580),
        ("Acapulco", -99.9100, 16.8530),
        ("Veracruz", -96.1342, 19.2000),
        ("Tampico", -97.8686, 22.2553),
    ),
    "mexico_pacific": (
        ("Ensenada", -116.6320, 31.8660),
        ("La Paz", -110.3090, 24.1420),
        ("Mazatlán", -106.4160, 23.1950),
        ("Puerto Vallarta", -105.2450, 20.6530),
        ("Manzanillo", -104.3350, 19.0520),
        ("Lázaro Cárdenas", -102.1950, 17.9580),
        ("Acapulco", -99.9100, 16.8530),
    ),
    "mexico_gulf": (
        ("Tampico", -97.8686, 22.2553),
        ("Altamira", -97.9090, 22.4010),
        ("Veracruz", -96.1342, 19.2000),
        ("Coatzacoalcos", -94.4150, 18.1490),
        ("Progreso", -89.6640, 21.2830),
    ),
    "pnw": (
        ("Seattle", -122.3380, 47.6062),
        ("Tacoma", -122.4443, 47.2529),
        ("Portland", -122.6750, 45.5231),
        ("Vancouver", -123.1139, 49.2827),
        ("Everett", -122.2021, 47.9790),
    ),
}

# Land raster bounds and cell size in degrees.
LAND_GRID = {"lat_min": 18.0, "lat_max": 50.0, "lon_min": -126.0, "lon_max": -66.0, "res_deg": 0.05}

AUDIT_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
MOTION_BUCKETS = ("straight", "maneuver", "anchored", "other")
