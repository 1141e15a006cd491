"""Values that define the results: aliases, word lists, thresholds."""

# --- Fixed values: source column aliases, per target column ------------------
COLUMN_ALIASES = {
    "facility_id": ["facility_id", "facilityid", "facility id", "id"],
    "facility_name": ["facility_name", "facilityname", "facility name", "name"],
    "state": ["state", "address_stateorregion", "stateorregion"],
    "district": ["district", "address_city", "city"],
    "pin_code": [
        "pin_code", "pincode", "pin code", "pin", "postal_code",
        "address_ziporpostcode", "ziporpostcode", "zipcode", "postcode",
    ],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "long", "lng"],
    "facility_type": ["facility_type", "facilitytype", "facility type", "type", "facilitytypeid"],
    "bed_count": ["bed_count", "bedcount", "bed count", "beds", "number_of_beds", "capacity"],
    "unstructured_notes": [
        "unstructured_notes", "notes", "description", "remarks", "comments", "details",
    ],
}

# Columns joined into the notes text, in this order.
NOTE_COLUMNS = ["description", "specialties", "procedure", "equipment", "capability", "numberdoctors"]

# Columns a valid row must have, and defaults for the others.
REQUIRED_COLUMNS = ["facility_name", "unstructured_notes"]
DEFAULTS = {"state": "Unknown", "district": "Unknown", "pin_code": "000000", "facility_type": "Unknown"}

# --- Fixed values: service categories and their keywords ---------------------
CATEGORY_KEYWORDS = {
    "emergency_surgery": ["emergency surgery", "surgical", "surgery", "operation theater"],
    "dialysis": ["dialysis", "nephrology", "kidney"],
    "oncology": ["oncology", "cancer", "chemotherapy", "radiation therapy"],
    "trauma": ["trauma", "emergency", "accident", "critical care"],
    "obstetrics": ["obstetrics", "maternity", "delivery", "gynecology", "obgyn"],
    "icu": ["icu", "intensive care", "critical care", "ventilator"],
    "pediatrics": ["pediatrics", "children", "child care", "neonatal"],
    "cardiology": ["cardiology", "heart", "cardiac", "ecg", "echocardiography"],
    "orthopedics": ["orthopedics", "bone", "fracture", "joint replacement"],
    "general_medicine": ["general medicine", "internal medicine", "physician"],
}

# --- Fixed values: thresholds and defaults -----------------------------------
EARTH_RADIUS_KM = 6371.0
GREEN_BELOW_KM = 50.0
YELLOW_BELOW_KM = 100.0
MIN_TRUST_SCORE = 60
MIN_CONFIDENCE = 0.7
DEFAULT_TRUST = 70           # score of a facility without one, on the map
DEFAULT_QUERY_TRUST = 50     # score of a facility without one, in lexical search
DEFAULT_VERDICT = 50         # score when a verdict holds no number
NOTES_PROMPT_CHARS = 4000
NOTES_PROFILE_CHARS = 500
SNIPPET_CHARS = 200
DEFAULT_IMPACT = -5
DEFAULT_SEVERITY = "medium"

# Postal code first digit -> approximate point, and the fallback.
PIN_REGIONS = {
    "1": (28.6, 77.2), "2": (26.9, 80.9), "3": (26.8, 75.8), "4": (19.0, 72.8),
    "5": (17.4, 78.5), "6": (13.0, 77.5), "7": (22.6, 88.4), "8": (23.0, 72.6),
}
PIN_REGION_FALLBACK = (22.5, 78.5)

# Fixed value: the sentence of a lexical search result (query, points, trust score).
LEXICAL_JUSTIFICATION = "Matched query '%s' with relevance score %d. Trust score: %d/100."
