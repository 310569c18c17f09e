"""Table schemas (fleet-wide, long core) and fixed values.

The fixed values below must equal the behaviour being reproduced; they are
stated plainly and together.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Missing-value tokens of a pandas CSV read with default NA handling, in the
# order pandas documents them, plus the logger format's own "NAN".
PANDAS_NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
LOGGER_NA_TOKENS = PANDAS_NA_TOKENS + ["NAN"]
FLAT_CSV_NA_TOKENS = list(PANDAS_NA_TOKENS)

# Accepted number grammar of the numeric coercion (decimal, exponent, inf).
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"

# Logger file format: marker, info-row field count, strict timestamp format.
LOGGER_MARKER = "TOA5"
LOGGER_INFO_FIELDS = 8
STRICT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Per-row fallbacks tried after the strict format (documented deviation).
FALLBACK_TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
]

HISTORICAL_SUFFIX = "_Historical"
BACKUP_EXTENSION_PREFIX = ".backup"

# Position-column detection: lower-cased exact names.
POSITION_NAMES = {
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "long"],
}

# Level-group column pattern: prefix _ <int level><unit letters> _ suffix.
LEVEL_PATTERN = r"^(.+?)_(\d+)([a-zA-Z]+)_(.+)$"

# Seed table of known raw column names -> (standard_name, units).
KNOWN_VARIABLES = [
    ("AirT_C", "air_temperature", "degC"),
    ("AirTC_Avg", "air_temperature", "degC"),
    ("temperature_Avg", "air_temperature", "degC"),
    ("temperature", "air_temperature", "degC"),
    ("RH", "relative_humidity", "%"),
    ("relative_humidity_Avg", "relative_humidity", "%"),
    ("relative_humidity", "relative_humidity", "%"),
    ("BP_mbar", "air_pressure", "mbar"),
    ("air_pressure_Avg", "air_pressure", "hPa"),
    ("WS_ms", "wind_speed", "m/s"),
    ("wind_speed_Avg", "wind_speed", "m/s"),
    ("wind_speed_corrected_Avg", "wind_speed", "m/s"),
    ("WindDir", "wind_from_direction", "degrees"),
    ("wind_direction_Avg", "wind_from_direction", "Deg"),
    ("wind_direction_corrected_Avg", "wind_from_direction", "Deg"),
    ("DP_C", "dew_point_temperature", "degC"),
    ("dewpoint_temperature_Avg", "dew_point_temperature", "degC"),
    ("surface_temperature_Avg", "surface_temperature", "degC"),
    ("SST_Avg", "sea_surface_temperature", "degC"),
    ("latitude", "latitude", "degrees_north"),
    ("longitude", "longitude", "degrees_east"),
    ("PAR_Avg", "surface_downwelling_photosynthetic_radiative_flux_in_air", "micromol/m2/s"),
]

# Messages of the validation findings and of the header check (own wording).
MESSAGES = {
    "both_shapes": "raw_name and extra_dimension exclude each other",
    "no_shape": "neither raw_name nor extra_dimension is given",
    "no_dimension": "extra_dimension is an empty list",
    "no_member": "a stacked variable has no members",
    "no_standard_name": "a stacked variable needs a standard_name",
    "scalar_value": "one dimension is declared, the member gives a list",
    "list_value": "%d dimensions are declared, the member does not give as many values",
    "raw_collision": "column %s belongs to variable %d and to variable %d",
    "no_deployment": "there is no deployment",
    "end_before_start": "the window ends before or when it starts",
    "open_not_last": "an open window is followed by another",
    "unsorted": "the next window starts earlier",
    "overlap": "windows %d and %d share time",
    "fixed_needs_position": "a fixed platform has no lat or no lon",
    "mobile_only_fields": "a fixed platform names a platform or an instrument set",
    "mobile_needs_platform": "a mobile platform has no platform_name",
    "fixed_only_fields": "a mobile platform has a fixed position",
    "mobile_needs_names": "a mobile platform has no variable for %s",
    "header_short": "fewer than 4 header rows",
    "header_fields": "%d fields expected in the first row, %d found",
    "header_marker": "the first row starts with another marker: ",
    # text formats of output attributes (fixed values)
    "quality_warning": "%s: %d value(s) could not be parsed as numeric and were set to NaN (examples: %s)",
    "history": "%sZ: generated by %s %s for dataset '%s' using config version %s",
}

# Config enumerations and defaults.
SOURCE_TYPES = ["loggernet", "generic_csv", "thingsboard"]
ACCESS_LEVELS = ["public", "restricted"]
PLATFORM_TYPES = ["fixed", "mobile"]
DTYPES = ["numeric", "string"]
DEFAULT_VOCABULARY = "CF-1.10"
SOFTWARE_NAME = "fleetseries"
SOFTWARE_VERSION = "0.1.0"
HISTORY_HASH_CHARS = 12

# Declared fields of each kind of config object: name, type, required, null allowed, choices.
_ANY: tuple[str, ...] = ()
CONFIG_FIELDS = {
    "document": [
        ("id", "text", True, False, _ANY), ("source_type", "choice", True, False, SOURCE_TYPES),
        ("access", "choice", True, False, ACCESS_LEVELS), ("source_config", "object", True, False, _ANY),
        ("variables", "list", True, False, _ANY), ("platform_type", "choice", True, False, PLATFORM_TYPES),
        ("deployments", "list", True, False, _ANY), ("metadata", "object", True, False, _ANY),
        ("output", "object", True, False, _ANY),
    ],
    "loggernet": [
        ("file_pattern", "text", True, False, _ANY), ("timestamp_column", "text", False, False, _ANY),
        ("table_name", "text", False, True, _ANY), ("historical_suffix", "text", False, False, _ANY),
        ("record_column", "text", False, False, _ANY), ("cache_enabled", "flag", False, False, _ANY),
    ],
    "generic_csv": [
        ("file_path", "text", True, False, _ANY), ("timestamp_column", "text", False, False, _ANY),
        ("cache_enabled", "flag", False, False, _ANY),
    ],
    "thingsboard": [("device_name", "text", True, False, _ANY)],
    "variable": [
        ("raw_name", "text", False, True, _ANY), ("old_names", "names", False, False, _ANY),
        ("standard_name", "text", False, True, _ANY), ("units", "text", False, True, _ANY),
        ("dtype", "choice", False, False, DTYPES), ("extra_dimension", "dimensions", False, True, _ANY),
        ("members", "list", False, False, _ANY),
    ],
    "dimension": [("name", "text", True, False, _ANY), ("units", "text", True, False, _ANY)],
    "member": [("raw_name", "text", True, False, _ANY), ("dimension_value", "value", True, False, _ANY)],
    "deployment": [
        ("start", "time", True, False, _ANY), ("end", "time", False, True, _ANY),
        ("lat", "number", False, True, _ANY), ("lon", "number", False, True, _ANY),
        ("elevation", "number", False, True, _ANY), ("platform_name", "text", False, True, _ANY),
        ("instrument_config", "text", False, True, _ANY), ("notes", "text", False, True, _ANY),
    ],
    "metadata": [
        ("title", "text", True, False, _ANY), ("institution", "text", False, True, _ANY),
        ("license", "text", False, True, _ANY), ("naming_authority", "text", False, True, _ANY),
        ("standard_name_vocabulary", "text", False, False, _ANY),
    ],
    "output": [("file_naming", "text", True, False, _ANY), ("publish", "flag", False, False, _ANY)],
}
TRUE_TEXTS = ["1", "true", "yes", "on", "t", "y"]
FALSE_TEXTS = ["0", "false", "no", "off", "f", "n"]
OPEN_KINDS = ["metadata"]  # kinds that keep further keys
VALUE_KINDS = {"text": "text", "number": "a number", "time": "a time", "flag": "true or false", "list": "a list",
               "names": "a list of texts", "object": "an object", "dimensions": "an object or a list",
               "value": "a number, a text or a list", "choice": "one of its values"}

# --- schemas -----------------------------------------------------------------
DIM = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("units", T.StringType()),
    T.StructField("num", T.DoubleType()),
    T.StructField("txt", T.StringType()),
])
DIMS = T.ArrayType(DIM)

RAW_ROWS = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_rank", T.IntegerType()),
    T.StructField("block_start", T.LongType()),
    T.StructField("row_pos", T.LongType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
])

FILE_HEADERS = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("logger_model", T.StringType()),
    T.StructField("serial_no", T.StringType()),
    T.StructField("os_version", T.StringType()),
    T.StructField("program_name", T.StringType()),
    T.StructField("program_sig", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("units", T.ArrayType(T.StringType())),
    T.StructField("agg_types", T.ArrayType(T.StringType())),
])

FILE_INDEX = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_role", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("time_start", T.TimestampNTZType()),
    T.StructField("time_end", T.TimestampNTZType()),
    T.StructField("variables", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
])

VARIABLE_MAP = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("var_ord", T.IntegerType()),
    T.StructField("canonical_name", T.StringType()),
    T.StructField("standard_name", T.StringType()),
    T.StructField("units", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("raw_name", T.StringType()),
    T.StructField("alias_ord", T.IntegerType()),
    T.StructField("member_ord", T.IntegerType()),
    T.StructField("dims", DIMS),
])

DEPLOYMENTS = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("dep_ord", T.IntegerType()),
    T.StructField("start", T.TimestampNTZType()),
    T.StructField("end", T.TimestampNTZType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("platform_name", T.StringType()),
    T.StructField("instrument_config", T.StringType()),
    T.StructField("notes", T.StringType()),
])

OBSERVATIONS = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("canonical_name", T.StringType()),
    T.StructField("dims", DIMS),
    T.StructField("value_num", T.DoubleType()),
    T.StructField("value_str", T.StringType()),
])

# JSON schema of one dataset config document (parsed with from_json).
_DIM_VALUE = T.StringType()  # scalar or list, kept as raw JSON text and parsed later
CONFIG_DOC = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("access", T.StringType()),
    T.StructField("source_config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("variables", T.ArrayType(T.StructType([
        T.StructField("raw_name", T.StringType()),
        T.StructField("old_names", T.ArrayType(T.StringType())),
        T.StructField("standard_name", T.StringType()),
        T.StructField("units", T.StringType()),
        T.StructField("dtype", T.StringType()),
        # a bare object or an array of objects; kept as JSON text
        T.StructField("extra_dimension", T.StringType()),
        T.StructField("members", T.ArrayType(T.StructType([
            T.StructField("raw_name", T.StringType()),
            T.StructField("dimension_value", _DIM_VALUE),
        ]))),
    ]))),
    T.StructField("platform_type", T.StringType()),
    T.StructField("deployments", T.ArrayType(T.StructType([
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        # numbers may be written as text
        T.StructField("lat", T.StringType()),
        T.StructField("lon", T.StringType()),
        T.StructField("elevation", T.StringType()),
        T.StructField("platform_name", T.StringType()),
        T.StructField("instrument_config", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]))),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("output", T.StructType([
        T.StructField("file_naming", T.StringType()),
        T.StructField("publish", T.StringType()),
    ])),
])
