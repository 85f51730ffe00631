"""Field names, domains, presets, places and rates.

Everything in this file is a fixed value that results depend on (source field
names, scoring domains, sentinel numbers, price rates). Nothing here is logic.
"""

# Coordinate systems (EPSG codes).
CRS_STORAGE = 4326
CRS_SOURCE_NAD83 = 4269
CRS_METRIC_UTM = 26911
CRS_METRIC_ALBERS = 3310

# Study area.
STATE_FIPS = "06"
COUNTY_FIPS = "029"
COUNTY_GEOID = "06029"
COUNTY_NAME = "Kern"
COUNTY_BBOX = (-120.20, 34.79, -117.62, 35.81)

SQM_PER_ACRE = 4046.8564224

# Candidate source field names, first present wins, case-insensitive.
FIELDS = {
    "apn": ["APN", "APN9", "ParcelID", "PARCEL_ID", "PARCELID", "APN_LABEL", "AIN"],
    "line_voltage": ["VOLTAGE", "VOLT_KV", "KV"],
    "line_class": ["VOLT_CLASS", "VOLTAGE_CLASS"],
    "line_owner": ["OWNER", "OPERATOR"],
    "line_type": ["TYPE", "LINE_TYPE"],
    "status": ["STATUS"],
    "source_id": ["ID", "OBJECTID", "OBJECTID_1"],
    "sub_max_voltage": ["MAX_VOLT", "MAX_VOLTAG", "VOLTAGE", "MAX_KV"],
    "sub_min_voltage": ["MIN_VOLT", "MIN_VOLTAG", "MIN_KV"],
    "sub_name": ["NAME", "SUB_NAME", "STATION"],
    "sub_type": ["TYPE", "SUB_TYPE"],
    "zone_code": ["Zn_Cd1", "ZONE", "ZONING", "ZONE_CODE", "ZONECODE", "ZONE_CD"],
    "zone_desc": ["Dscrptn", "DESCRIPTION", "ZONE_DESC", "DESC"],
    "zone_combined": ["Comb_Zn", "COMBINED", "COMB_ZONE"],
    "gp_desig": ["GP_DESIG", "DESIG", "GP_CODE", "GPDESIG"],
    "gp_lu": ["LU_DESC", "LU_DESCRIP", "LANDUSE", "DESCRIPTION"],
    "sp_name": ["SP_NAME_1", "SP_NAME", "NAME", "PLAN_NAME"],
    "flood_zone": ["FLD_ZONE", "ZONE", "FLD_ZONE_1", "FLDZONE"],
    "flood_subtype": ["ZONE_SUBTY", "ZONE_SUBTYPE", "SUBTYPE"],
    "flood_flag": ["SFHA_TF", "SFHA"],
    "flood_id": ["FLD_AR_ID", "OBJECTID", "OBJECTID_1", "DFIRM_ID", "GFID"],
    "queue_id": ["Queue ID", "Queue Position", "queue_id"],
    "queue_name": ["Project Name", "Project Name - Confidential", "name"],
    "queue_type": ["Generation Type", "Type-1", "type"],
    "queue_fuel": ["Fuel-1", "Fuel", "fuel"],
    "queue_status": ["Status", "Application Status", "status"],
    "queue_mw": ["Capacity (MW)", "Net MWs to Grid", "MW-1", "mw"],
    "queue_county": ["County", "county"],
    "queue_state": ["State", "state"],
    "queue_owner": ["Transmission Owner", "Utility", "PTO"],
    "queue_poi": ["Interconnection Location", "Station or Transmission Line",
                  "Point of Interconnection", "POI"],
    "queue_voltage": ["Voltage (kV)", "POI Voltage (kV)", "Voltage", "kV"],
    "queue_date": ["Queue Date", "queue_date"],
    "queue_done": ["Proposed Completion Date", "Current On-line Date"],
    "grid_ghi": ["avg_ghi", "ghi", "annual_ghi"],
    "grid_dni": ["avg_dni", "dni", "annual_dni"],
    "grid_tilt": ["avg_lat_tilt", "lat_tilt", "annual_lat_tilt"],
    "grid_lon": ["lon", "longitude", "x"],
    "grid_lat": ["lat", "latitude", "y"],
    "plant_id": ["Plant Code", "plant_id", "Plant ID", "plant_code", "EIA_ID"],
    "plant_name": ["Plant Name", "plant_name", "name"],
    "plant_mw": ["Nameplate Capacity (MW)", "capacity_mw", "nameplate_mw", "MW"],
    "plant_fuel": ["Technology", "technology", "Energy Source 1", "prime_mover", "fuel"],
    "plant_status": ["Status", "status", "operating_status"],
    "plant_county": ["County", "county"],
    "plant_lon": ["lon", "longitude", "Longitude", "x"],
    "plant_lat": ["lat", "latitude", "Latitude", "y"],
    "exclusion_name": ["name", "NAME", "Unit_Nm", "GAP_Sts", "GNIS_NAME", "label", "TYPE"],
    "exclusion_id": ["id", "OBJECTID", "FID", "OBJECTID_1", "GFID", "Source_PAID"],
}

EXCLUSION_KINDS = ["protected_area", "open_water", "built_up"]

# Cleaning rules.
VOLTAGE_UNKNOWN = [-999999.0, -999998.0]
FLOOD_NOT_MAPPED = "AREA NOT INCLUDED"
INACTIVE_STATUS = ["withdraw", "complete", "in service", "operational", "suspend", "deactiv", "cancel"]
STATION_NOISE_WORDS = ["SUBSTATION", "SUBSTATIONS", "SUB", "STATION", "SWITCHYARD", "SWITCHING",
                       "SWYD", "TAP", "JCT", "JUNCTION", "KV"]
POI_RADIUS_M = 10_000.0
POI_MIN_NAME_LEN = 4

# Zoning rules.
ZONING_USE_CASES = ["solar", "wind", "storage", "data_center"]
ZONING_PERMISSIONS = ["by_right", "conditional", "prohibited"]
ZONING_DEFAULT_PERMISSION = "conditional"
ZONING_DEFAULT_BASIS = "DEFAULT — no curated rule for this district; conservative fallback ([CONFIRM])"
ZONE_CODE_PATTERN = "^[A-Za-z0-9][A-Za-z0-9 ./-]{0,31}$"

# Scoring factors: key -> (parcel column, direction, low, high, label, unit).
FACTORS = {
    "ghi": ("ghi", "higher", 4.5, 6.5, "Solar resource (GHI)", "kWh/m²/day"),
    "slope": ("mean_slope_pct", "lower", 0.0, 15.0, "Terrain slope", "%"),
    "tx_distance": ("dist_tx_m", "lower", 0.0, 20000.0, "Distance to transmission line", "m"),
    "sub_distance": ("dist_sub_m", "lower", 0.0, 20000.0, "Distance to substation", "m"),
    "sub_capacity": ("nearest_sub_kv", "higher", 0.0, 500.0, "Nearest substation voltage", "kV"),
    "acreage": ("acres", "higher", 0.0, 640.0, "Parcel size", "acres"),
    "competition": ("poi_competition_mw", "lower", 0.0, 2000.0, "Queued interconnection competition", "MW"),
}
NEUTRAL = 0.5

# Presets: zoning use case, thresholds and factor weights.
PRESETS = {
    "utility_solar": {
        "zoning_use_case": "solar",
        "min_acres": 20.0,
        "max_slope_pct": 15.0,
        "weights": {"ghi": 0.25, "slope": 0.20, "tx_distance": 0.20, "sub_distance": 0.15,
                    "acreage": 0.15, "sub_capacity": 0.05},
    },
    "data_center": {
        "zoning_use_case": "data_center",
        "min_acres": 5.0,
        "max_slope_pct": 15.0,
        "weights": {"tx_distance": 0.25, "sub_capacity": 0.20, "sub_distance": 0.20, "slope": 0.15,
                    "acreage": 0.10, "competition": 0.10},
    },
}

RAW_COLUMNS = [
    "id", "apn", "acres", "mean_slope_pct", "mean_slope_pct_final", "ghi", "dist_tx_m", "dist_sub_m",
    "nearest_sub_kv", "poi_competition_mw", "poi_competition_n", "sfha_flag", "zoning_class",
    "excl_protected_area", "excl_open_water", "excl_built_up", "eia_nearest_m",
]

# Request limits.
MAX_VERTICES = 50_000
MAX_LIMIT = 1000
DEFAULT_LIMIT = 200
MAX_AREA_SQM = 5_000_000_000.0
REPORT_MAX_PARCELS = 25
PAGE_SIZE = 20

# Economics.
AFFORDABILITY_WEIGHT = 0.12
AFFORDABILITY_LOW_USD = 150_000.0
AFFORDABILITY_HIGH_USD = 600_000.0
CENSUS_NO_ESTIMATE = -100_000_000

# Place centres (lon, lat) and aliases.
PLACES = {
    "bakersfield": (-119.018, 35.373),
    "delano": (-119.247, 35.769),
    "shafter": (-119.272, 35.501),
    "wasco": (-119.341, 35.594),
    "mcfarland": (-119.229, 35.678),
    "arvin": (-118.833, 35.209),
    "lamont": (-118.913, 35.259),
    "taft": (-119.456, 35.142),
    "maricopa": (-119.401, 35.059),
    "tehachapi": (-118.449, 35.132),
    "mojave": (-118.174, 35.052),
    "california city": (-117.986, 35.126),
    "rosamond": (-118.163, 34.864),
    "boron": (-117.650, 34.994),
    "ridgecrest": (-117.671, 35.622),
    "lake isabella": (-118.473, 35.614),
    "frazier park": (-118.945, 34.822),
    "buttonwillow": (-119.468, 35.401),
    "lost hills": (-119.692, 35.616),
    "oildale": (-119.020, 35.420),
    "edwards": (-117.891, 34.905),
}
PLACE_ALIASES = {
    "cal city": "california city",
    "edwards afb": "edwards",
    "edwards air force base": "edwards",
    "isabella": "lake isabella",
    "ridge crest": "ridgecrest",
}
COUNTY_ALIASES = ["kern", "kern county", "county", "all", "all of kern", "entire county",
                  "whole county", "kern county, ca", "kern county california"]
PLACE_PAD_DEG = 0.06
REGION_PAD_DEG = 0.5

# Token prices, USD per million: model fragment -> (input, output, cached input).
TEXT_RATES = {
    "gemini-3.5-flash": (1.50, 9.00, 0.15),
    "gemini-3.1-pro": (2.50, 15.00, 0.25),
    "gemini-2.5-flash": (0.30, 2.50, 0.075),
    "gemini": (1.50, 9.00, 0.15),
}
DEFAULT_TEXT_RATE = (1.50, 9.00, 0.15)
VOICE_TEXT_IN, VOICE_TEXT_OUT = 5.0, 20.0
VOICE_AUDIO_IN, VOICE_AUDIO_OUT = 32.0, 64.0
VOICE_AUDIO_CACHED = 0.40
TRANSCRIBE_AUDIO_IN = 3.0
DEFAULT_BUDGET_USD = 3.0

# Terrain and tiles.
SLOPE_NODATA = -9999.0
SLOPE_SCREEN_M, SLOPE_FINAL_M = 30, 10
GRID_SPACING_DEG = 0.1
TILE_MIN_ZOOM, TILE_MAX_ZOOM = 8, 16

# Layers a build must have.
REQUIRED_LAYERS = ["county_boundary", "parcels", "transmission_lines", "substations", "flood_sfha",
                   "zoning", "caiso_queue", "slope_raster", "ghi_grid"]
