"""Word lists, patterns, lookup tables and limits.

Everything here must hold exactly these values for results to be right; no
logic lives in this module. Patterns are Java regular expressions: ``(?U)``
gives Unicode-aware ``\\b``/``\\s``, ``(?iU)`` is case-insensitive as well.
"""

# --- marketplaces -----------------------------------------------------------
AUTOSCOUT24 = "AutoScout24"
KLEINANZEIGEN = "Kleinanzeigen"
AUTOUNCLE = "AutoUncle"
CLASSIC_TRADER = "Classic Trader"
MOBILE_DE = "mobile.de"
SOURCES = [AUTOSCOUT24, KLEINANZEIGEN, AUTOUNCLE, CLASSIC_TRADER, MOBILE_DE]

# host fragment -> marketplace, tested in this order
HOST_MARKS = [
    ("kleinanzeigen", KLEINANZEIGEN),
    ("autoscout24", AUTOSCOUT24),
    ("autouncle", AUTOUNCLE),
    ("classic-trader", CLASSIC_TRADER),
    ("mobile", MOBILE_DE),
]
PLACEHOLDER_ID_PREFIXES = ["ka-", "as24-", "mobile-"]
CARD_CITIES = ["München", "Hamburg", "Berlin", "Köln", "Düsseldorf", "Stuttgart", "Frankfurt"]
DETAIL_LABELS = [
    "Kilometerstand", "Fahrzeugzustand", "Erstzulassung", "Kraftstoffart", "Leistung",
    "Getriebe", "Fahrzeugtyp", "HU bis", "Marke", "Modell",
]

# --- enumerated domains -----------------------------------------------------
TRIMS = ["Base", "Grand Sport", "Z06", "ZR1", "Special Edition"]
TRANSMISSIONS = ["manual", "automatic", "unknown"]
BODY_STYLES = ["Cabrio", "Coupé", "Targa", "unknown"]
UNKNOWN_ACCIDENT = "unbekannt"
NOT_AVAILABLE = "k.A."

# --- number patterns --------------------------------------------------------
GROUPED_NUMBER = r"\d{1,3}(?:[.\s]\d{3})+"
PRICE_SCAN = rf"(?iU)(?<!\d)({GROUPED_NUMBER}|\d{{4,6}})\s*(€|EUR|VB)?(?!\d)"
PRICE_RANGE = (5_000, 500_000)
KM_WORD = r"(?U)\bkm\b"
MILEAGE = rf"(?iU)(?<!\d)({GROUPED_NUMBER}|\d{{5,6}})\s*km\b"
MILEAGE_LIMIT = 500_000
POWER_HP = r"(?iU)\b(\d{3,4})\s*(?:PS|HP)\b"
POWER_HP_RANGE = (250, 1000)
POWER_KW = r"(?iU)\b(\d{3})\s*kW\b"
POWER_KW_RANGE = (100, 1000)
MODEL_YEAR = r"(?iU)(?:MJ|Modelljahr|Baujahr)\s*:?\s*(20\d{2})"
MODEL_YEAR_RANGE = (2004, 2014)
MONTH_YEAR = (
    r"(?iU)(?:EZ|Erstzulassung|HU|TÜV|TUV)?\s*(0?[1-9]|1[0-2])[./-](20\d{2}|19\d{2})"
)
INSPECTION_WORDS = ["hu", "tüv", "tuv"]
PRODUCTION_YEAR = r"(?U)\b(200[5-9]|201[0-3])\b"
PRODUCTION_YEARS = (2005, 2013)
INSPECTION = r"(?iU)(?:HU|TÜV|TUV)\s*(?:bis)?\s*(0?[1-9]|1[0-2])[./-](20\d{2})"
DISPLACEMENT = r"(?iU)(?<![\d.,])([67][,.]\d)\s*(?:l|liter)\b"
DISPLACEMENT_CC = {"6.0": 5967, "6.2": 6162, "7.0": 7008}
SUPERCHARGED_62 = r"(?U)6[,.]2\s*(?:sc|supercharged|kompressor)"
SUPERCHARGED_CC = 6162
OWNERS_LABELLED = r"(?U)(?:anzahl\s+vorbesitzer|vorbesitzer)\s*:?\s*(\d{1,2})"
OWNERS_HAND = r"(?U)(\d{1,2})\s*\.?\s*hand\b"
OWNERS_RANGE = (1, 20)
VIN = r"(?iU)\b[1-9A-HJ-NPR-Z]{17}\b"
VIN_WITH_ZERO = r"(?iU)\b[0-9A-HJ-NPR-Z]{17}\b"
CONDITION_PATTERNS = [
    r"(?U)fahrzeugzustand\s*:?\s*([^;,\n]{2,40})",
    r"(?U)zustand\s*:?\s*([^;,\n]{2,40})",
]

# --- price labels -----------------------------------------------------------
LABEL_FREE, LABEL_NEGOTIABLE, LABEL_ON_REQUEST = "zu verschenken", "VB", "auf Anfrage"
NEGOTIABLE_WORD = r"(?U)\bvb\b"

# --- engine -----------------------------------------------------------------
ENGINE_CODES = ["LS9", "LS7", "LS3", "LS2"]
ENGINE_70 = r"(?U)(?<!\d)7[,.]0\s*(?:L|V8|V\s*8|$)"
ENGINE_62 = r"(?U)(?<!\d)6[,.]2\s*(?:L|V8|V\s*8|$)"
ENGINE_60 = r"(?U)(?<!\d)6[,.]0\s*(?:L|V8|V\s*8|$)"
ZR1_ACCESSORY = (
    r"(?U)\bZR1\s+(?:STYLE|OPTIK|FELGEN|SPOILER|LOOK|EMBLEM|BADGE|REPLIKA|UMBAU|KIT|GRILL"
    r"|HOOD|FENDER|RIMS|WHEELS|DECAL)"
)
# low hp, high hp, engine, confidence
POWER_BANDS = [
    (395, 410, "LS2", 0.86),
    (425, 445, "LS3", 0.86),
    (500, 520, "LS7", 0.90),
    (630, 660, "LS9", 0.92),
]
STOCK_HP = {"LS2": 404, "LS3": 437, "LS7": 512, "LS9": 647}
ENGINE_TRIMS = {
    "LS9": ["ZR1"],
    "LS7": ["Z06"],
    "LS3": ["Base", "Grand Sport", "Special Edition"],
    "LS2": ["Base", "Special Edition"],
}

# --- trim, gearbox, body ----------------------------------------------------
TRIM_WORDS = [
    ("ZR1", ["ZR1", "ZR 1"]),
    ("Z06", ["Z06", "Z 06", "ZO6"]),
    ("Grand Sport", ["GRAND SPORT", "GRAND-SPORT"]),
    ("Special Edition", ["427", "CENTENNIAL"]),
]
MANUAL_WORDS = ["schalter", "schaltgetriebe", "handschaltung", "manual", "6-gang"]
MANUAL_WORD = r"(?U)\bmanuell\b"
AUTOMATIC_WORDS = ["automatik", "automatic", "a6", "aut."]
BODY_WORDS = [
    ("Cabrio", ["cabrio", "convertible", "roadster"]),
    ("Targa", ["targa", "t-top", "t top", "removable roof", "hardtop"]),
    ("Coupé", ["coupé", "coupe", "coup"]),
]
DRIVE_WORDS = [
    ("Heckantrieb", ["heckantrieb", "hinterradantrieb", "rwd", "rear wheel drive"]),
    ("Allrad", ["allrad", "awd", "4wd", "vierradantrieb"]),
]

# --- paperwork, equipment ---------------------------------------------------
NO_SERVICE_WORDS = ["ohne scheckheft", "kein scheckheft"]
SERVICE_WORDS = ["scheckheft", "scheckheftgepflegt", "serviceheft"]
NO_WARRANTY_WORDS = ["ohne garantie", "keine garantie"]
WARRANTY_WORDS = ["garantie"]
MAGNETIC_RIDE_WORDS = ["magnetic ride", "magneticride", "f55"]
ACTIVE_EXHAUST_WORDS = ["klappenauspuff", "npp", "active exhaust", "bimodal"]
HEAD_UP_WORDS = ["head-up-display", "head up display", "hud", "headup"]
HEAD_UP_BLOCKER = "hudson"
NAVIGATION_WORDS = ["navigationssystem", "navigation", "navi"]
BOSE_WORD, BOSE_BLOCKER = "bose", "bosch"
LEATHER_WORDS = ["lederausstattung", "ledersitze", "leder", "leather"]
LEATHER_BLOCKER = "lederlenkrad"
LEATHER_SEAT_WORDS = ["lederausstattung", "ledersitze", "leder sitze"]
HEATED_SEAT_WORDS = ["sitzheizung", "heated seats", "sitzbeheizung"]

# --- accident and risk ------------------------------------------------------
ACCIDENT_WORDS = ["nicht unfallfrei", "unfallwagen", "unfallschaden", "reparierter unfall"]
ACCIDENT_FREE_WORD = "unfallfrei"
RISK_WORDS = [
    ("accident_reported", ACCIDENT_WORDS),
    ("damage_reported", ["frontschaden", "seitenschaden", "motorschaden", "getriebeschaden",
                         "schaden", "beschädigt"]),
    ("no_tuv", ["ohne tüv", "ohne tuv", "hu abgelaufen", "nicht fahrbereit"]),
    ("salvage_import_possible", ["us import", "usa import", "salvage", "rebuilt", "clean title",
                                 "carfax"]),
    ("mileage_unclear", ["meilen", "miles", "abgelesen", "laut vorbesitzer"]),
    ("modified_heavily", ["kompressorumbau", "tracktool", "rennstrecke", "softwareoptimierung"]),
    ("sold_or_reserved", ["verkauft", "reserviert"]),
]

# --- candidate predicate ----------------------------------------------------
MODEL_WORD = "CORVETTE"
GENERATION = "C6"
MODEL_NAME = "Chevrolet Corvette C6"
WANTED_TITLE = r"(?iU)\bsuche\b"
GENERATION_TOKEN = r"(?iU)\bC\s*6\b"
LATER_GENERATION = r"(?iU)\bC\s*[78]\b|STINGRAY C\s*7|MID ENGINE"
LATER_ENGINE = r"(?iU)\b(LT1|LT2|LT4|LT5)\b|\b5[,.]5\s*V8\b"

# --- cluster keys -----------------------------------------------------------
COLOR_BASES = {
    "schwarz": "black", "weiss": "white", "weiß": "white", "rot": "red", "blau": "blue",
    "grün": "green", "gruen": "green", "gelb": "yellow", "grau": "gray", "grey": "gray",
    "silber": "silver", "braun": "brown", "orange": "orange", "lila": "purple",
    "violett": "purple", "beige": "beige", "creme": "cream", "gold": "gold", "bronze": "bronze",
}
KEY_LEVELS = ["full", "no_trim", "no_loc", "no_eng", "legacy"]
PRICE_BUCKET, MILEAGE_BUCKET, POWER_BUCKET = 1000, 5000, 50
CROSS_FILL_FIELDS = [
    "price_eur", "price_label", "mileage_km", "engine", "probable_engine", "engine_confidence",
    "engine_note", "power_hp", "estimated_power_hp", "power_note", "trim", "first_registration",
    "tuv_until", "transmission", "body_style", "exterior_color", "interior_color",
    "location_raw", "location_country", "origin_country", "origin_confidence", "seller_type",
    "vin", "description_text", "accident_status", "damage", "has_damage", "eu_spec",
]
MERGED_LIST_FIELDS = [
    "equipment", "risk_flags", "inference_notes", "conflict_flags", "visual_flags", "image_urls",
]

# --- scoring ----------------------------------------------------------------
SCORING = {
    "base_score": 20,
    "budget": {"engine": 25, "transmission": 15, "trim": 12, "body": 10, "mileage": 10,
               "completeness": 5, "eu_spec": 3},
    "engine_distribution": {"LS2": 0.0, "LS3": 0.33, "LS7": 0.66, "LS9": 1.0},
    "trim_distribution": {"Base": 0.0, "Grand Sport": 0.33, "Z06": 0.66, "ZR1": 1.0},
    "mileage_distribution": [
        {"max_km": 30000, "fraction": 1.0},
        {"max_km": 80000, "fraction": 0.5},
        {"max_km": 150000, "fraction": 0.2},
    ],
    "transmission": {"manual": 1.0, "automatic": 0.3},
    "completeness_fields": 4,
    "risk_penalties": {"accident_reported": 18, "damage_reported": 14,
                       "salvage_import_possible": 10, "mileage_unclear": 8, "no_tuv": 8,
                       "modified_heavily": 4, "sold_or_reserved": 20},
}
PREFERENCES = {"price_eur": 3, "mileage_km": 3, "model_year": 3, "accident": 3, "eu_spec": 3,
               "transmission": 0, "body_style": 0, "power_hp": 3, "power_hp_dir": 0}
WEIGHTED_FACTORS = ["price_eur", "mileage_km", "model_year", "accident", "eu_spec", "power_hp"]

# --- validation: code -> (field, severity, message; {} is the value) --------
VALIDATION = {
    "price_negative": ("price_eur", "critical", "Preis negativ ({} €)"),
    "price_zero": ("price_eur", "error", "Preis ist 0 € — wahrscheinlich Fehler beim Extrahieren"),
    "price_very_low": ("price_eur", "warning", "Preis ungewöhnlich niedrig ({} €)"),
    "price_very_high": ("price_eur", "warning", "Preis ungewöhnlich hoch ({} €)"),
    "price_missing": ("price_eur", "info", "Kein Preis extrahiert"),
    "mileage_negative": ("mileage_km", "critical", "Laufleistung negativ ({} km)"),
    "mileage_zero": ("mileage_km", "error",
                     "Laufleistung ist 0 km — wahrscheinlich Fehler beim Extrahieren"),
    "mileage_very_low": ("mileage_km", "warning", "Laufleistung ungewöhnlich niedrig ({} km)"),
    "mileage_very_high": ("mileage_km", "warning", "Laufleistung ungewöhnlich hoch ({} km)"),
    "mileage_missing": ("mileage_km", "info", "Keine Laufleistung extrahiert"),
    "power_negative": ("power_hp", "critical", "Leistung negativ ({} PS)"),
    "power_zero": ("power_hp", "error",
                   "Leistung ist 0 PS — wahrscheinlich Fehler beim Extrahieren"),
    "power_very_low": ("power_hp", "warning", "Leistung ungewöhnlich niedrig ({} PS)"),
    "power_very_high": ("power_hp", "warning", "Leistung ungewöhnlich hoch ({} PS)"),
    "year_out_of_range": ("first_registration", "warning",
                          "EZ-Jahr {} liegt außerhalb der C6-Produktionszeit (2004–2014)"),
    "engine_trim_mismatch": ("engine", "warning", "Motor {} passt nicht zu Trim {} (erwartet: {})"),
    "trim_missing": ("trim", "info", "Kein Trim erkannt — als Base gelistet"),
    "body_style_missing": ("body_style", "info", "Keine Karosserieform erkannt"),
    "price_fully_missing": (
        "price_eur", "warning",
        "Weder Preis noch Preis-Label extrahiert — wahrscheinlich Blockierung oder Parsing-Fehler"),
    "price_below_historical_range": (
        "price_eur", "info",
        "Preis ({} €) liegt deutlich unter historischem Bereich (Q1={}, IQR={})"),
    "price_above_historical_range": (
        "price_eur", "info",
        "Preis ({} €) liegt deutlich über historischem Bereich (Q3={}, IQR={})"),
    "mileage_above_historical_range": (
        "mileage_km", "info",
        "Laufleistung ({} km) liegt deutlich über historischem Bereich (Q3={}, IQR={})"),
}
PRICE_FLOOR, PRICE_CEILING = 100, 500_000
MILEAGE_FLOOR, MILEAGE_CEILING = 100, 500_000
POWER_FLOOR, POWER_CEILING = 50, 1200
REGISTRATION_YEARS = (2004, 2014)
OUTLIER_MIN_POPULATION, OUTLIER_IQR_FACTOR = 10, 3.0

# --- overrides --------------------------------------------------------------
PROTECTED_FIELDS = [
    "id", "source", "source_listing_id", "url", "change_type", "previous_price_eur", "cluster_id",
    "engine_confidence", "engine_note", "power_note", "estimated_power_hp", "origin_confidence",
    "inference_notes", "conflict_flags", "risk_flags", "validation_flags", "ai_enrichment", "score",
]

# --- availability -----------------------------------------------------------
STATUS_TTL_SECONDS = 300
MAX_REDIRECT_HOPS = 3
GONE_PATTERNS = [
    r"anzeige\s+(?:wurde\s+)?(?:leider\s+)?nicht\s+gefunden",
    r"die\s+gesuchte\s+anzeige\s+ist\s+nicht\s+mehr\s+vorhanden",
    r"<title>[^<]*nicht\s+gefunden[^<]*</title>",
    r"<h1[^>]*>[^<]*nicht\s+gefunden[^<]*</h1>",
    r"dieses\s+(?:angebot|inserat|objekt)\s+(?:ist\s+)?nicht\s+mehr\s+"
    r"(?:vorhanden|verfügbar|verfuegbar)",
    r"listing\s+(?:is\s+)?(?:no\s+longer\s+)?not\s+found",
    r"offer\s+(?:is\s+)?(?:no\s+longer\s+)?(?:available|found)",
    r"page\s+not\s+found",
    r"404\s+not\s+found",
    r"dieses\s+objekt\s+wurde\s+entfernt",
    r"this\s+(?:ad|listing)\s+(?:has\s+been\s+)?removed",
    r"(?:anzeige|inserat|objekt|ad|listing)\s+(?:wurde|ist|wird)\s+gelöscht",
    r"showDeletedVeil\s*:\s*true",
    r"showPausedVeil\s*:\s*true",
]
GONE_VEILS = r"(?U)showDeletedVeil\s*:\s*true|showPausedVeil\s*:\s*true"
LIVE_VEILS = [r"(?iU)showDeletedVeil\s*:\s*false", r"(?iU)showPausedVeil\s*:\s*false"]
LISTING_TYPES = ["Vehicle", "Car", "Product"]
IN_STOCK = "InStock"
GUID = r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
NUMERIC_AD_ID = r"/(\d+)-216-"
QUERY_AD_ID = r"[?&]id=(\d+)"
CHALLENGE_TITLE, CHALLENGE_HOST, CHALLENGE_TOKEN = (
    "Just a moment", "challenges.cloudflare.com", "cf_chl_opt")
CHALLENGE_VENDOR = "cloudflare"

# --- images -----------------------------------------------------------------
AS24_IMAGE_HOST = "prod.pictures.autoscout24.net/listing-images/"
AS24_RENDITION = r"/\d+x\d+\.(?:webp|jpg)$"
AS24_LARGE = "/1920x1080.webp"
KA_IMAGE_HOST = "img.kleinanzeigen.de/api/v1/prod-ads/images/"
KA_IMAGE_URL = r"https://img\.kleinanzeigen\.de/api/v1/prod-ads/images/[^\s,\"'<>;)]+"
KA_RULE = r"\?rule=\$_\d+\.(?:AUTO|JPG)"
KA_LARGE = "?rule=$_59.AUTO"

# --- crawl quality, exports -------------------------------------------------
QUALITY_MIN_TOTAL = 10
QUALITY_MIN_BY_SOURCE = {AUTOSCOUT24: 5, KLEINANZEIGEN: 10}
CSV_COLUMNS = [
    "id", "source", "title", "price_eur", "price_label", "mileage_km", "trim", "engine",
    "power_hp", "estimated_power_hp", "power_note", "transmission", "body_style",
    "inference_notes", "conflict_flags", "location_raw", "score", "change_type", "url",
]
KNOWN_FIELDS = [
    "price_eur", "mileage_km", "engine", "probable_engine", "engine_confidence", "power_hp",
    "trim", "first_registration", "tuv_until", "transmission", "exterior_color",
    "interior_color", "accident_status", "damage", "location_raw", "origin_country", "risk_flags",
]
DETAIL_FIELDS = [
    "price_eur", "price_label", "mileage_km", "engine", "probable_engine", "engine_confidence",
    "engine_note", "power_hp", "estimated_power_hp", "power_note", "trim", "first_registration",
    "tuv_until", "transmission", "body_style", "accident_status", "damage", "has_damage",
    "origin_country", "origin_confidence", "vin",
]
MISSING_PRICE_LAST = 999_999_999

# --- fixed values: lines of the text feed -----------------------------------

FEED_TITLE = "# Neue C6 Corvette-Angebote — %s"
FEED_COUNTS = "Aktive Treffer: **%s** · Neu: **%s** · Preisänderungen: **%s**"
FEED_EMPTY = "Keine C6-Corvette-Angebote gefunden oder Quellen waren blockiert."
