"""Word lists, patterns, formats and run settings of the data source."""

# ---- fixed values: title rules for guitar listings, first match wins -----------------
CATEGORY_RULES = [
    ("Elektrisk gitar", r"\b(electric|elektrisk|strat|stratocaster|telecaster|les\s*paul|sg\b|flying\s*v|explorer|jazzmaster|jaguar|offset|superstrat|soloist|dinky|jackson|esp|ltd|prs|epiphone)\b"),
    ("Akustisk gitar", r"\b(akustisk|acoustic|western|dreadnought|jumbo|parlor|fingerstyle|folk\s*gitar|steel\s*string)\b"),
    ("Klassisk gitar", r"\b(klassisk|classical|nylon|spansk|flamenco)\b"),
    ("Bass", r"\b(bass|precision|jazz\s*bass|p-bass|j-bass)\b"),
    ("Forsterker", r"\b(amp|amps|amplifier|forsterker|combo|rørforsterker|tube\s*amp|head\b|cabinet|cab\b|stack|marshall|fender\s*(twin|deluxe|blues|hot\s*rod|champion|mustang)|vox|orange|mesa|boogie|peavey|blackstar|boss\s*katana|katana|roland)\b"),
    ("Effektpedal", r"\b(pedal|pedaler|pedalboard|overdrive|distortion|fuzz|delay|reverb|chorus|phaser|flanger|wah|looper|tuner\s*pedal|strymon|tc\s*electronic|boss\b|mxr|electro.harmonix|ehx)\b"),
    ("Tilbehør", r"\b(strenger|strings|capo|picks|plekter|stemmers|tuner|strap|reim|kabel|jack|stand|stativ|veske|bag|case|koffert|gigbag|hard\s*case)\b"),
    ("Bok/media", r"\b(bok|bøker|book|lærebok|noter|tabs|tab\s*book|dvd|cd|lær\s*deg|learn|course|kurs)\b"),
    ("Ukulele", r"\b(ukulele|uke)\b"),
    ("Banjo/mandolin", r"\b(banjo|mandolin)\b"),
]
DEFAULT_CATEGORY = "Annet"

BRANDS = [
    "fender", "gibson", "yamaha", "ibanez", "epiphone", "taylor", "martin",
    "prs", "esp", "ltd", "jackson", "schecter", "squier", "gretsch",
    "rickenbacker", "dean", "cort", "takamine", "ovation", "guild",
    "marshall", "vox", "orange", "mesa", "peavey", "blackstar", "boss",
    "tc electronic", "strymon", "mxr", "electro-harmonix", "ehx",
    "line 6", "behringer", "roland", "korg", "zoom", "digitech",
    "seymour duncan", "dimarzio", "emg",
    "harley benton", "lag", "godin", "córdoba", "cordoba", "alhambra",
]
DEFAULT_BRAND = "Unknown"

CONDITION_RULES = [
    ("Ny/ubrukt", r"\b(ny\b|nye\b|ubrukt|uåpnet|sealed|brand\s*new|splitter\s*ny)\b"),
    ("Pent brukt", r"\b(pent\s*brukt|god\s*stand|lite\s*brukt|velholdt|very\s*good|excellent|mint)\b"),
    ("Brukt", r"\b(brukt|used|second.hand)\b"),
    ("Defekt", r"\b(defekt|ødelagt|broken|repareres|reparasjon|deler|parts|for\s*parts)\b"),
    ("Vintage", r"\b(vintage|retro|antikk|gammel|samleobjekt|collector)\b"),
]
DEFAULT_CONDITION = "Ukjent"

YEAR_PATTERN = r"\b(19[5-9]\d|20[0-2]\d)\b"

# ---- fixed values: page formats -------------------------------------------------------
SEARCH_BLOB_PATTERN = r"(?s)<script[^>]*>(eyJ[^<]+)</script>"
SCRIPT_PATTERN = r"(?s)<script[^>]*>(.*?)</script>"
HYDRATION_PATTERN = r'(?s)window\.__staticRouterHydrationData\s*=\s*JSON\.parse\("(.*)"\)'
FOLLOWER_PATTERN = r"(?U)(\d+)\s+følger"
COMPANY_PATTERN = r"(?s)<companyProfilePodlet-isolated[^>]*>(.*?)</companyProfilePodlet-isolated>"

FLAG_PRIVATE = "private"
FLAG_RETAILER = "retailer"
FLAG_SHIPPING = "shipping_exists"
FLAG_BUY_NOW = "buy_now"

# ---- fixed values: trade types, labels, bins ------------------------------------------
FOR_SALE = "Til salgs"
CURRENCY = "NOK"
IMAGE_BIN_EDGES = [0, 1, 3, 5, 10, 100]
IMAGE_BIN_LABELS = ["1", "2-3", "4-5", "6-10", "10+"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]

# ---- fixed values: run settings -------------------------------------------------------
PAGE_SIZE = 50
MAX_PAGES = 50
SEED = 42
TFIDF_TERMS = 8000
RIDGE_ALPHA = 1.0
GBT_SETTINGS = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6,
                "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
PAD_TOKEN = "<PAD>"
UNK_TOKEN = "<UNK>"
MAX_SEQUENCE = 100
EMBEDDING_DIM = 32
HIDDEN_DIMS = [64, 64]

# ---- fixed values: feature lists ------------------------------------------------------
BOOLEAN_COLUMNS = ["is_private", "is_retailer", "has_shipping", "has_buy_now", "is_promoted"]
BINARY_FEATURES = ["is_private", "is_retailer", "has_shipping", "has_buy_now"]
CATEGORICAL_FEATURES = ["trade_type", "brand"]
PRICE_FEATURES = ["num_images", "is_retailer", "has_shipping", "has_buy_now",
                  "coordinates_lat", "coordinates_lon", "title_len", "title_word_count",
                  "has_year_in_title", "listing_age_days", "hour_posted"]
DISCRETE_PRICE_FEATURES = ["is_retailer", "has_shipping", "has_buy_now", "has_year_in_title"]
TITLE_FEATURES = ["item_category", "brand_from_title", "condition"]
