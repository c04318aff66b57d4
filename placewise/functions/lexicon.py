"""Fixed values of the text operators: rewrite rules, keyword lists and patterns."""

# Ordered rewrites of lower-cased addresses: (pattern, replacement). Later rules see earlier output.
ABBREVIATION_RULES = [
    (r"\bno\.?\b", "number"),
    (r"\bflat\.?\b", "flat"),
    (r"\bapt\.?\b", "apartment"),
    (r"\bapts?\.?\b", "apartments"),
    (r"\bbldg\.?\b", "building"),
    (r"\bsoc\.?\b", "society"),
    (r"\bsociety\.?\b", "society"),
    (r"\bsec\.?\b", "sector"),
    (r"\bsect\.?\b", "sector"),
    (r"\bblk\.?\b", "block"),
    (r"\bflr\.?\b", "floor"),
    (r"\brd\.?\b", "road"),
    (r"\bst\.?\b", "street"),
    (r"\bave\.?\b", "avenue"),
    (r"\bln\.?\b", "lane"),
    (r"\bdr\.?\b", "drive"),
    (r"\bcrs?\.?\b", "cross"),
    (r"\bgali\.?\b", "gali"),
    (r"\bgl\.?\b", "gali"),
    (r"\bxrd?\.?\b", "cross"),
    (r"\bmain\.?\b", "main"),
    (r"\bcross\.?\b", "cross"),
    (r"\bnear\.?\b", "near"),
    (r"\bopp\.?\b", "opposite"),
    (r"\boppst\.?\b", "opposite"),
    (r"\bbehind\.?\b", "behind"),
    (r"\bbhnd\.?\b", "behind"),
    (r"\bnext\s+to\.?\b", "next to"),
    (r"\bcorner\.?\b", "corner"),
    (r"\bentrance\.?\b", "entrance"),
    (r"\bbackside\.?\b", "backside"),
    (r"\bback\s+side\.?\b", "backside"),
    (r"\bke\s+peeche?\b", "behind"),
    (r"\bke\s+paas\b", "near"),
    (r"\bke\s+paas\s+mein\b", "near"),
    (r"\bsamne\b", "opposite"),
    (r"\bpas\b", "near"),
    (r"\bpaas\b", "near"),
    (r"\bpichhe\b", "behind"),
    (r"\bpeeche\b", "behind"),
    (r"\baage\b", "in front"),
    (r"\bbaad\b", "after"),
    (r"\bpurana\b", "old"),
    (r"\bnaya\b", "new"),
    (r"\bchota\b", "small"),
    (r"\bbada\b", "big"),
    (r"\bmandir\b", "temple"),
    (r"\bmasjid\b", "mosque"),
    (r"\bgurudwara\b", "gurudwara"),
    (r"\bchurch\b", "church"),
    (r"\bhospital\b", "hospital"),
    (r"\bschool\b", "school"),
    (r"\bcollege\b", "college"),
    (r"\bbank\b", "bank"),
    (r"\bpost\s*office\b", "post office"),
    (r"\bration\s*shop\b", "ration shop"),
    (r"\bkirana\b", "kirana"),
    (r"\bmedical\b", "medical"),
    (r"\bclinic\b", "clinic"),
    (r"\bpetrol\s*pump\b", "petrol pump"),
    (r"\bbus\s*stop\b", "bus stop"),
    (r"\brailway\s*station\b", "railway station"),
    (r"\bmetro\s*station\b", "metro station"),
    (r"\bpolice\s*station\b", "police station"),
    (r"\bmarket\b", "market"),
    (r"\bchowk\b", "chowk"),
    (r"\bmod\b", "mod"),
    (r"\bphatak\b", "phatak"),
    (r"\bpul\b", "bridge"),
    (r"\bbridge\b", "bridge"),
    (r"\bnaka\b", "naka"),
    (r"\bgate\b", "gate"),
    (r"\bdarwaza\b", "gate"),
]

# Script ranges in tie order: (language, first code point, last code point).
SCRIPT_RANGES = [
    ("hi", "ऀ", "ॿ"),
    ("bn", "ঀ", "৿"),
    ("gu", "઀", "૿"),
    ("pa", "਀", "੿"),
    ("kn", "ಀ", "೿"),
    ("ml", "ഀ", "ൿ"),
    ("or", "଀", "୿"),
    ("ta", "஀", "௿"),
    ("te", "ఀ", "౿"),
]

# Spatial relation patterns in order.
RELATION_PATTERNS = [
    r"\b(behind|backside|back\s+side|pichhe|peeche|ke\s+peeche)\b",
    r"\b(near|nearby|close\s+to|pas|paas|ke\s+paas|ke\s+pas)\b",
    r"\b(opposite|opp|samne|front\s+of)\b",
    r"\b(next\s+to|beside|adjacent)\b",
    r"\b(after|past|beyond|baad)\b",
    r"\b(before|prior\s+to)\b",
    r"\b(between|in\s+between)\b",
    r"\b(around|surrounding)\b",
    r"\b(inside|within|in)\b",
    r"\b(outside|out\s+of)\b",
    r"\b(corner|junction)\b",
    r"\b(entrance|entry|gate)\b",
    r"\b(left\s+of|left)\b",
    r"\b(right\s+of|right)\b",
    r"\b(north\s+of|north)\b",
    r"\b(south\s+of|south)\b",
    r"\b(east\s+of|east)\b",
    r"\b(west\s+of|west)\b",
]

# Landmark words by category; the order decides which one names the landmark.
LANDMARK_WORDS = {
    "religious": ["temple", "mandir", "masjid", "mosque", "gurudwara", "church", "dargah", "ashram"],
    "commercial": ["market", "bazaar", "shop", "store", "mall", "showroom", "complex", "plaza"],
    "financial": ["bank", "atm", "post office", "postoffice"],
    "medical": ["hospital", "clinic", "medical", "pharmacy", "chemist", "dispensary"],
    "education": ["school", "college", "university", "institute", "academy"],
    "transport": ["bus stop", "busstand", "railway station", "metro station", "petrol pump", "fuel station"],
    "government": ["police station", "tehsil", "collectorate", "municipal", "panchayat", "court"],
    "food": ["restaurant", "hotel", "dhaba", "cafe", "bakery", "sweet shop"],
    "residential": ["apartment", "flat", "society", "colony", "nagar", "vihar", "enclave", "residency"],
    "infrastructure": ["bridge", "pul", "flyover", "underpass", "tunnel", "dam", "canal"],
    "landmark": ["chowk", "mod", "phatak", "naka", "gate", "darwaza", "circle", "square", "statue", "monument"],
    "utility": ["water tank", "electricity", "transformer", "substation", "tower"],
}

HOUSE_NUMBER_PATTERNS = [
    r"\b(?:house|h\.?no|flat|unit|apartment|apt)\s*[#\-:]?\s*([a-z0-9\-/]+)",
    r"\b([0-9]+[a-z]?(?:[\-/][0-9]+[a-z]?)?)\b(?=\s+(?:street|road|lane|cross|main|avenue))",
    r"\bplot\s*[#\-:]?\s*([a-z0-9\-/]+)",
    r"\bdoor\s*[#\-:]?\s*([a-z0-9\-/]+)",
    r"\b(?:no|number)\s*[#\-:]?\s*([a-z0-9\-/]+)",
]
BUILDING_PATTERNS = [
    r"\b([a-z\s]+?)\s+(?:apartment|apt|society|soc|building|bldg|residency|complex|tower|heights|plaza)\b",
    r"\b(?:apartment|apt|society|soc|building|bldg|residency|complex|tower|heights|plaza)\s+(?:named\s+)?([a-z\s]+?)(?:\s+(?:road|street|lane|cross|main|sector|phase|block))",
]
CROSS_PATTERN = r"\b(\d+(?:st|nd|rd|th)?)\s*(?:cross|crs|xrd)\b"
ROAD_PATTERN = r"\b([a-z\s]+?)\s+(?:road|rd|street|st|lane|ln|avenue|ave|main|cross)\b"
FLOOR_PATTERN = r"\b(?:floor|flr|fl)\s*[#\-:]?\s*([0-9]+(?:st|nd|rd|th)?|ground|g|lower|upper|basement)"
BLOCK_PATTERN = r"\b(?:block|blk|wing|tower|building|bldg)\s*[#\-:]?\s*([a-z0-9]+)"
SECTOR_PATTERN = r"\b(?:sector|sec|phase)\s*[#\-:]?\s*([0-9]+[a-z]?)"
LOCALITY_SUFFIXES = ["nagar", "vihar", "colony", "enclave", "puram", "ganj", "bagh"]
DIRECTION_WORDS = [
    "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest",
    "left", "right", "front", "back", "behind",
]
STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana",
    "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya",
    "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura",
    "uttar pradesh", "uttarakhand", "west bengal", "andaman and nicobar islands", "chandigarh",
    "dadra and nagar haveli", "daman and diu", "delhi", "jammu and kashmir", "ladakh", "lakshadweep", "puducherry",
]
STATE_CODES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ga": "goa",
    "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala",
    "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland",
    "od": "odisha", "or": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu",
    "ts": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand", "wb": "west bengal", "dl": "delhi",
    "jk": "jammu and kashmir", "la": "ladakh", "py": "puducherry",
}

# Gazetteer parser: landmark types with their words in several scripts.
LANDMARK_TYPE_WORDS = {
    "community_hall": ["community", "mantapa", "barat", "baraat", "samudaya", "बारात", "ಮಂಟಪ", "ಸಮುದಾಯ"],
    "ration_shop": ["ration", "pds", "nyayabele", "राशन", "ನ್ಯಾಯಬೆಲೆ"],
    "ganesha_temple": ["ganesh", "ganesha", "ganapathi", "ganapati", "गणेश", "ಗಣಪತಿ", "ಗಣೇಶ"],
    "masjid": ["masjid", "mosque", "masidi", "मस्जिद", "ಮಸೀದಿ"],
    "bus_stop": ["bus", "बस", "ಬಸ್"],
    "post_office": ["post", "dak", "anche", "डाकघर", "डाक", "ಅಂಚೆ"],
    "medical_store": ["medical", "medicals", "pharmacy", "dawai", "मेडिकल", "दवाई", "ಮೆಡಿಕಲ್"],
    "church": ["church", "girja", "चर्च", "गिरजा", "ಚರ್ಚ್"],
    "govt_school": ["school", "shaale", "shale", "स्कूल", "ಶಾಲೆ"],
    "hanuman_temple": ["hanuman", "anjaneya", "हनुमान", "ಹನುಮಾನ್", "ಹನುಮಾನ", "ಆಂಜನೇಯ"],
    "milk_dairy": ["milk", "doodh", "haalina", "dairy", "दूध", "डेयरी", "ಹಾಲಿನ", "ಡೈರಿ"],
    "water_tank": ["tank", "tanki", "टंकी", "ಟ್ಯಾಂಕ್"],
    "petrol_bunk": ["petrol", "पेट्रोल", "ಪೆಟ್ರೋಲ್"],
    "park": ["park", "bagicha", "udyanavana", "पार्क", "ಉದ್ಯಾನವನ"],
}
BEHIND_WORDS = ["bhd", "behind", "hinde", "hindhe", "peeche", "piche", "पीछे", "ಹಿಂದೆ"]
OPPOSITE_WORDS = ["opp", "opposite", "eduru", "edhuru", "edurru", "samne", "saamne", "सामने", "ಎದುರು"]
TOKEN_ABBREVIATIONS = {
    "layt": "layout", "lyt": "layout", "layou": "layout",
    "nagr": "nagar", "ngr": "nagar", "ngar": "nagar", "naagar": "nagar", "nagra": "nagar", "naagr": "nagar",
    "colny": "colony", "col": "colony",
}
_ORDINAL = r"\b(\d{1,2})\s*(?:st|nd|rd|th)?"
STREET_PATTERNS = {
    "cross": [_ORDINAL + r"\s*(?:cross|crss|crs|cr|x)\b", r"\b(?:cross|crs|cr)\s*(?:no\.?\s*)?(\d{1,2})\b"],
    "main": [_ORDINAL + r"\s*(?:mainn|main|mn)\b", r"\b(?:main|mn)\s*(?:no\.?\s*)?(\d{1,2})\b"],
    "gali": [r"(?:gali|glai|gli|gai|गली)\s*(?:no|नं)?[\s.\-]*(\d{1,2})\b", _ORDINAL + r"\s*(?:gali|गली)"],
    "ward": [r"\bward\s*(?:no)?[\s.\-]*(\d{1,2})\b", r"वार्ड\s*(?:नं)?[\s.\-]*(\d{1,2})"],
    "road": [_ORDINAL + r"\s*(?:road|rd|rad)\b", r"\b(?:road|rd|rad)\s*(?:no\.?\s*)?(\d{1,2})\b"],
    "block": [r"\b(?:block|blk)\s*([a-h])\b", r"\b([a-h])\s*(?:block|blk)\b"],
}
LOCALITY_THRESHOLD = 82.0
LANDMARK_THRESHOLD = 84.0

REMARK_PATTERN = (
    r"(?:actual|house|ghar|address|location).{0,80}(?:gali|lane|street|aage|behind|near|opposite).{0,80}"
)

# Sentence for a landmark by its relation.
RELATION_SENTENCES = {
    "BEHIND": "Go behind {}.",
    "NEAR": "Look near {}.",
    "OPPOSITE": "Go opposite {}.",
    "NEXT_TO": "Go next to {}.",
    "AFTER": "Go past {}, then continue.",
    "BEFORE": "Stop before {}.",
    "BETWEEN": "Go between {} and the next landmark.",
    "AROUND": "Go around {}.",
    "INSIDE": "Go inside {}.",
    "OUTSIDE": "Go outside {}.",
    "CORNER": "Turn at the corner of {}.",
    "ENTRANCE": "Enter through {} entrance.",
    "BACKSIDE": "Go to the backside of {}.",
    "FRONT": "Go to the front of {}.",
    "LEFT": "Turn left at {}.",
    "RIGHT": "Turn right at {}.",
    "NORTH": "Go north from {}.",
    "SOUTH": "Go south from {}.",
    "EAST": "Go east from {}.",
    "WEST": "Go west from {}.",
}
