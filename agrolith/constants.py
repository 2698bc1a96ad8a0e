"""Registries that results depend on."""

from __future__ import annotations

#: Vendor codes of missing values; anything at or below FILL_FLOOR counts too.
FILL_VALUES = (-99.0, -999.0, -9000.0, -9999.0, -99999.0)
FILL_FLOOR = -900.0

#: Daily weather variables fetched by default.
DAILY_VARIABLES = ("T2M", "T2M_MAX", "T2M_MIN", "T2MDEW", "ALLSKY_SFC_LW_DWN", "ALLSKY_SFC_SW_DWN", "ALLSKY_SFC_SW_DNI", "ALLSKY_SFC_PAR_TOT", "ALLSKY_SFC_UVA", "ALLSKY_SFC_UVB", "PRECTOTCORR", "EVPTRNS", "QV2M", "RH2M", "GWETROOT", "GWETTOP", "FROST_DAYS", "WS2M")
#: Hourly weather variables fetched by default.
HOURLY_VARIABLES = ("T2M", "T2MDEW", "RH2M", "QV2M", "PS", "WS2M", "PRECTOTCORR", "ALLSKY_SFC_SW_DWN", "ALLSKY_SFC_LW_DWN", "ALLSKY_SFC_PAR_TOT", "TS", "T2MWET")

#: Columns that describe an environment-day, not weather.
META_COLUMNS = ("env", "LON", "LAT", "YEAR", "MM", "DD", "DOY", "YYYYMMDD", "daysFromStart")
#: Columns that process_weather makes anew.
PROCESSED_COLUMNS = ("n_sun", "N", "RTA", "VPD", "SPV", "ETP", "PETP", "GDD", "FRUE", "T2M_RANGE")
#: Columns that a climate shift makes stale.
STALE_AFTER_SHIFT = ("n_sun", "N", "RTA", "VPD", "SPV", "ETP", "PETP", "GDD", "FRUE", "T2M_RANGE", "dTT", "cumTT", "stage", "dstage", "stage_day")

#: Crop -> base, upper temperature, day type, optimal photoperiod, cumulative thermal time at each stage's end, scale.
PHENOLOGY = {
    "maize": (10.0, 30.0, "short", 12.5, {"VE": 125, "V6": 475, "V12": 740, "VT": 1135, "R1": 1250, "R3": 1660, "R5": 2110, "R6": 2700}, "Abendroth V/R"),
    "sorghum": (10.0, 34.0, "short", 12.5, {"EM": 130, "GP3": 450, "FI": 800, "BT": 1150, "ANT": 1350, "SD": 1750, "PM": 2300}, "Vanderlip GS"),
    "pearl_millet": (10.0, 34.0, "short", 12.0, {"EM": 100, "GP3": 350, "PI": 600, "BT": 850, "ANT": 1000, "GF": 1350, "PM": 1700}, "Maiti GS"),
    "sugarcane": (12.0, 32.0, "neutral", 12.5, {"GERM": 400, "TILL": 1600, "GRAND": 4500, "MAT": 6500}, "phenophase"),
    "wheat": (0.0, 26.0, "long", 16.0, {"EM": 150, "TS": 500, "SE": 900, "HD": 1250, "ANT": 1400, "GF": 2000, "PM": 2400}, "Zadoks-anchored"),
    "barley": (0.0, 26.0, "long", 16.0, {"EM": 130, "TS": 450, "SE": 800, "HD": 1100, "ANT": 1220, "GF": 1750, "PM": 2100}, "Zadoks-anchored"),
    "oat": (0.0, 25.0, "long", 16.0, {"EM": 140, "TS": 480, "SE": 850, "HD": 1180, "ANT": 1300, "GF": 1850, "PM": 2250}, "Zadoks-anchored"),
    "rice": (10.0, 30.0, "short", 12.5, {"EM": 100, "TIL": 450, "PI": 900, "HD": 1350, "ANT": 1450, "GF": 1900, "PM": 2300}, "Counce P/R"),
    "soybean": (10.0, 30.0, "short", 12.8, {"VE": 120, "V3": 400, "R1": 800, "R3": 1150, "R5": 1500, "R6": 1900, "R8": 2400}, "Fehr-Caviness V/R"),
    "common_bean": (10.0, 30.0, "short", 12.5, {"V1": 130, "V3": 350, "R5": 600, "R6": 750, "R7": 950, "R8": 1250, "R9": 1500}, "CIAT V/R"),
    "chickpea": (0.0, 30.0, "long", 13.0, {"EM": 150, "VEG": 600, "FLI": 900, "POD": 1200, "SF": 1550, "PM": 1900}, "phenophase"),
    "groundnut": (10.0, 32.0, "neutral", 12.5, {"VE": 130, "R1": 500, "R3": 800, "R5": 1150, "R6": 1500, "R7": 1900, "R8": 2300}, "Boote R"),
    "cowpea": (11.0, 32.0, "short", 12.5, {"EM": 100, "VEG": 350, "FLI": 600, "POD": 850, "SF": 1150, "PM": 1450}, "phenophase"),
    "canola": (5.0, 27.0, "long", 16.0, {"EM": 120, "ROS": 400, "STE": 700, "BUD": 950, "FLW": 1250, "POD": 1700, "PM": 2100}, "BBCH-anchored"),
    "sunflower": (6.0, 30.0, "neutral", 12.5, {"VE": 90, "V8": 400, "R1": 700, "R5": 1050, "R6": 1300, "R8": 1650, "R9": 2000}, "Schneiter-Miller V/R"),
    "cotton": (15.6, 32.0, "neutral", 12.5, {"EM": 60, "SQ": 450, "FB": 800, "PB": 1150, "OB": 1600, "CO": 2100}, "nodes/phenophase"),
    "potato": (7.0, 30.0, "long", 14.0, {"EM": 200, "VEG": 500, "TI": 700, "TB": 1400, "MAT": 1900}, "phenophase"),
    "cassava": (13.0, 30.0, "neutral", 12.5, {"EM": 250, "BR1": 1200, "BR2": 2600, "BULK": 4500, "MAT": 6000}, "phenophase"),
    "safflower": (5.0, 30.0, "long", 14.0, {"EM": 95, "ROS": 450, "STE": 800, "BUD": 1100, "FL": 1400, "SF": 1800, "PM": 2200}, "BBCH-anchored"),
    "alfalfa": (5.0, 30.0, "long", 14.0, {"EV": 150, "LV": 350, "EB": 550, "LB": 700, "EF": 850, "LF": 1000}, "Kalu-Fick MSC"),
}

#: Variable -> class breaks and labels of the default risk classes.
RISK_CLASSES = {
    "T2M_MAX": ((30.0, 35.0), ("safe", "heat_mild", "heat_severe")),
    "T2M_MIN": ((8.0, 14.0), ("cold_severe", "cold_mild", "safe")),
    "T2M": ((18.0, 28.0), ("cool", "optimal", "hot")),
    "PETP": ((-5.0, 0.0), ("drought_severe", "drought_mild", "wet")),
    "PRECTOT": ((1.0, 10.0), ("dry", "moderate", "wet")),
    "VPD": ((1.5, 2.5), ("low", "moderate", "high")),
    "FRUE": ((0.5, 0.8), ("severe", "limiting", "non_limiting")),
    "Ks": ((0.4, 0.8), ("severe", "moderate", "none")),
}

#: Divisors that turn soil codes into units.
SOIL_DIVISORS = {"bdod": 100.0, "cec": 10.0, "cfvo": 10.0, "clay": 10.0, "sand": 10.0, "silt": 10.0, "nitrogen": 100.0, "soc": 10.0, "ocd": 10.0, "ocs": 10.0, "phh2o": 10.0, "wv0010": 1000.0, "wv0033": 1000.0, "wv1500": 1000.0}
#: Soil layers and their bounds in mm.
SOIL_LAYERS = {"0-5cm": (0.0, 50.0), "5-15cm": (50.0, 150.0), "15-30cm": (150.0, 300.0), "30-60cm": (300.0, 600.0), "60-100cm": (600.0, 1000.0), "100-200cm": (1000.0, 2000.0)}

#: Climate models, scenarios, periods, and what the archive lacks.
CLIMATE_MODELS = ("ACCESS-CM2", "BCC-CSM2-MR", "CMCC-ESM2", "EC-Earth3-Veg", "FIO-ESM-2-0", "GFDL-ESM4", "GISS-E2-1-G", "HadGEM3-GC31-LL", "INM-CM5-0", "IPSL-CM6A-LR", "MIROC6", "MPI-ESM1-2-HR", "MRI-ESM2-0", "UKESM1-0-LL")
CLIMATE_SCENARIOS = ("ssp126", "ssp245", "ssp370", "ssp585")
CLIMATE_PERIODS = ("2021-2040", "2041-2060", "2061-2080", "2081-2100")
CLIMATE_GAPS = {"GFDL-ESM4": ("ssp245", "ssp585"), "FIO-ESM-2-0": ("ssp370",), "HadGEM3-GC31-LL": ("ssp370",)}

#: Labels of the zone codes 1 to 57, in order.
ZONES = (
    "Tropics, lowland; semi-arid",
    "Tropics, lowland; sub-humid",
    "Tropics, lowland; humid",
    "Tropics, lowland; per-humid",
    "Tropics, highland; semi-arid",
    "Tropics, highland; sub-humid",
    "Tropics, highland; humid",
    "Tropics, highland; per-humid",
    "Subtropics, warm; semi-arid",
    "Subtropics, warm; sub-humid",
    "Subtropics, warm; humid",
    "Subtropics, warm; per-humid",
    "Subtropics, moderately cool; semi-arid",
    "Subtropics, moderately cool; sub-humid",
    "Subtropics, moderately cool; humid",
    "Subtropics, moderately cool; per-humid",
    "Subtropics, cool; semi-arid",
    "Subtropics, cool; sub-humid",
    "Subtropics, cool; humid",
    "Subtropics, cool; per-humid",
    "Subtropics, cold; semi-arid",
    "Subtropics, cold; sub-humid",
    "Subtropics, cold; humid",
    "Subtropics, cold; per-humid",
    "Temperate, moderate; semi-arid",
    "Temperate, moderate; sub-humid",
    "Temperate, moderate; humid",
    "Temperate, moderate; per-humid",
    "Temperate, cool; semi-arid",
    "Temperate, cool; sub-humid",
    "Temperate, cool; humid",
    "Temperate, cool; per-humid",
    "Temperate, cold; semi-arid",
    "Temperate, cold; sub-humid",
    "Temperate, cold; humid",
    "Temperate, cold; per-humid",
    "Boreal, cold; semi-arid",
    "Boreal, cold; sub-humid",
    "Boreal, cold; humid",
    "Boreal, cold; per-humid",
    "Boreal, very cold; semi-arid",
    "Boreal, very cold; sub-humid",
    "Boreal, very cold; humid",
    "Boreal, very cold; per-humid",
    "Arctic / very cold",
    "Desert, tropical",
    "Desert, subtropical",
    "Desert, temperate",
    "Desert, boreal / arctic",
    "Land with severe soil constraints",
    "Land with steep terrain",
    "Land with poor drainage",
    "Water bodies",
    "Urban / built-up",
    "Protected area",
    "Barren / very sparse vegetation",
    "No data / unclassified",
)

#: Positions of a site against the training envelope, in order.
POSITIONS = ("interpolation", "edge", "mild_extrapolation", "gross_extrapolation")
