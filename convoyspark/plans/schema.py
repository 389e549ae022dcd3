"""Canonical column names and the fixed values of the planning domain."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. These lists must equal the published data format.
# ---------------------------------------------------------------------------

# Columns an uploaded plan file must have.
REQUIRED_COLUMNS = (
    "plan_id", "camp_label", "allocated_haj", "number_of_buses", "number_of_haj",
    "get_type_parking", "get_parking_name", "get_parking_geom",
    "set_type_parking", "set_parking_name", "set_parking_geom",
    "entrance_asm_code", "entrance_name", "entrance_point_geom", "entrance_polygon",
    "start_point_name", "start_geom", "start_point_district", "start_point_type", "start_point_geom",
    "end_point_name", "end_geom", "end_point_type", "end_point_geom",
    "path_geom", "path_name", "internal_path",
    "owner_company_name", "owner_office_number", "period",
    "timing_start_at", "timing_start_at_hijri", "timing_end_at", "timing_end_at_hijri",
    "plan_type_name", "plan_type_code", "transport_type_name",
)

# Columns whose cells must be numbers.
NUMERIC_COLUMNS = (
    "allocated_haj", "number_of_buses", "number_of_haj",
    "number_of_late_haj", "number_of_early_haj", "owner_office_number",
)

# Canonical column -> human heading accepted in its place.
PLAN_ALIASES = {
    "plan_id": "ID",
    "camp_label": "End point name",
    "number_of_buses": "Number of buses",
    "number_of_haj": "Number of haj",
    "period": "Period",
    "timing_start_at": "Start time",
    "timing_end_at": "End time",
    "plan_type_name": "Plan type",
    "plan_type_code": "Plan type code",
    "transport_type_name": "Transport type",
    "entrance_name": "Entrance",
    "entrance_asm_code": "Entrance code",
    "path_name": "Path",
    "path_geom": "Path GIS",
    "start_point_type": "Start point type",
    "start_point_name": "Start point name",
    "end_point_type": "End point type",
    "end_point_name": "End point name",
    "owner_company_name": "Company",
    "owner_office_number": "Owner",
    "get_type_parking": "Get parking type",
    "get_parking_name": "Get parking",
    "set_type_parking": "Set parking type",
    "set_parking_name": "Set parking",
}

# Plan types in the order in which they are shown.
PLAN_TYPE_ORDER = ("tarwia", "direct_taseed", "taseed_tarwia", "efada", "nafra")

# Plan types that make up the headline total, by code and by name.
HEADLINE_TYPE_CODES = ("tarwia", "direct_taseed")
HEADLINE_TYPE_NAMES = ("تروية", "تصعيد مباشر")

# Transport types that are always offered, with the trips one bus makes.
TRANSPORT_TRIPS = {"ترددي": 3, "تقليدي رد": 1, "تقليدي ردين": 2, "قطار": 3}

# Phrase that marks domestic pilgrims.
DOMESTIC = "حجاج الداخل"

# Labels shown where a value is missing; each metric has its own.
UNKNOWN = "غير معروف"
NO_ENTRANCE = "بدون مدخل"
NO_PATH = "بدون مسار"
NO_DISTRICT = "بدون حي"
NO_CENTER = "بدون مركز"
NOT_GIVEN = "غير محدد"
NOT_AVAILABLE = "غير متوفر"
UNKNOWN_CODE = "unknown"

# The filter's own names for missing values.
FILTER_NO_ENTRANCE = "No Entrance"
FILTER_NO_PATH = "No Path"
FILTER_NO_DISTRICT = "No District"

# ---------------------------------------------------------------------------

#: Text columns that may hold a geometry (WKT or GeoJSON).
GEOMETRY_COLUMNS = (
    "internal_path", "path_geom", "entrance_polygon", "entrance_point_geom",
    "start_geom", "start_point_geom", "end_geom", "end_point_geom",
    "get_parking_geom", "set_parking_geom",
)

#: Numeric plan columns after the cast (the office number stays text).
DOUBLE_COLUMNS = tuple(c for c in NUMERIC_COLUMNS if c != "owner_office_number")

#: Source order of a row, from ingest: ``_row``, with ``_sub`` breaking ties if present.
ROW = "_row"
SUB = "_sub"
