"""Word lists, weights, thresholds and patterns that decide results.

Everything here is data. The values have to equal the published behaviour of the system whose
results are matched, so they are stated plainly and in their natural order.
"""

# --- fixed values: ranking -------------------------------------------------------------------
COMPETITOR_VARIANTS = ["PARKSTREET", "PARK STREET", "PARK-STREET", "MHW", "M.H.W", "MHW LTD", "MHW LIMITED"]

SPIRITS_SCORES = {
    "SINGLE MALT SCOTCH WHISKY": 35, "COGNAC": 35, "MEZCAL FB": 35, "MEZCAL": 35,
    "STRAIGHT BOURBON WHISKY": 32, "STRAIGHT RYE WHISKY": 32, "TEQUILA FB": 32, "TEQUILA": 32,
    "BOURBON WHISKY": 30, "RYE WHISKY": 30, "VODKA": 30, "VODKA SPECIALTIES": 30, "RUM": 30,
    "RUM SPECIALTIES": 30, "GIN": 30, "OTHER GIN": 30,
    "OTHER RUM (WHITE)": 28, "OTHER RUM": 28, "OTHER WHISKY BIB": 28, "WHISKY SPECIALTIES": 28,
    "OTHER STRAIGHT WHISKY": 28, "WHISKY": 28, "SCOTCH WHISKY": 28,
    "COFFEE (CAFE) LIQUEUR": 25, "COFFEE LIQUEUR": 25, "OTHER FRUITS & PEELS LIQUEURS": 25,
    "LIQUEUR": 25, "LIQUEURS": 25, "STRAIGHT BOURBON WHISKY BLENDS": 25,
    "STRAIGHT RYE WHISKY BLENDS": 25, "WHISKY BLENDS": 25, "BRANDY": 25, "ARMAGNAC": 25,
}
WINE_SCORES = {
    "SPARKLING WINE/CHAMPAGNE": 20, "CHAMPAGNE": 20, "SPARKLING WINE": 20, "84": 20,
    "DESSERT /PORT/SHERRY/(COOKING) WINE": 18, "PORT": 18, "SHERRY": 18, "DESSERT WINE": 18, "88": 18,
    "TABLE RED WINE": 15, "TABLE WHITE WINE": 15, "ROSE WINE": 15, "RED WINE": 15, "WHITE WINE": 15,
    "80": 15, "81": 15, "80A": 15,
    "HONEY BASED TABLE WINE": 12, "APPLE TABLE WINE/CIDER": 12, "FRUIT WINE": 12, "82M": 12, "83C": 12,
}
BEER_SCORES = {
    "MALT BEVERAGES SPECIALITIES - FLAVORED": 10, "MALT BEVERAGES SPECIALTIES": 10, "STOUT": 10,
    "PORTER": 10, "IPA": 10, "906": 10, "904": 10, "900": 10,
    "ALE": 8, "BEER": 8, "LAGER": 8, "PILSNER": 8, "902": 8, "901": 8,
}
PRODUCT_SCORES = {**SPIRITS_SCORES, **WINE_SCORES, **BEER_SCORES}
PREMIUM_TERMS = [
    "SINGLE MALT", "COGNAC", "MEZCAL", "CHAMPAGNE", "STRAIGHT BOURBON", "STRAIGHT RYE", "XO", "VSOP",
    "RESERVE", "ESTATE", "GRAND CRU", "PREMIER CRU",
]
SCORE_COMPETITOR, SCORE_IMPORTER, SCORE_WEBSITE = 40, 20, 15
SCORE_RECENT, SCORE_COUNTRIES, SCORE_PERMITS, SCORE_PREMIUM = 5, 5, 3, 2
RECENT_DAYS = 180
TIER_LABELS = {
    0: "Tier 1 - Poaching Target (MHW/Parkstreet)",
    1: "Critical Priority - Auto Enrichment",
    2: "High Priority - Batch Processing",
    3: "Standard Priority - Manual Review",
    4: "Low Priority - On Request",
    5: "Manual Only - Inactive/Test",
}

# --- fixed values: permits and geography -------------------------------------------------------
PERMIT_TYPE_NAMES = {
    "DSP": "Distilled Spirits Producer", "BWN": "Bonded Winery", "BR": "Brewer", "BG": "Beer Growler",
}
REPORT_STATES = [
    "CALIFORNIA", "NEW YORK", "TEXAS", "FLORIDA", "PENNSYLVANIA", "OREGON", "WASHINGTON", "VIRGINIA",
    "MICHIGAN", "NEW JERSEY",
]
US_NAMES = ["UNITED STATES", "USA", "U.S.", "US"]
CHART_STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware",
    "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky",
    "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri",
    "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York",
    "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island",
    "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington",
    "West Virginia", "Wisconsin", "Wyoming", "District of Columbia",
]
CATEGORY_KEYWORDS = {
    "Wine": ["WINE", "SPARKLING WINE", "DESSERT WINE", "APERITIF WINE"],
    "Beer": ["BEER", "ALE", "LAGER", "STOUT", "PORTER", "IPA", "WHEAT BEER"],
    "Spirits": ["WHISKY", "VODKA", "GIN", "RUM", "TEQUILA", "BRANDY", "LIQUEUR"],
}
KEYWORD_STOP_WORDS = ["THE", "OF", "AND", "A", "AN", "IN", "ON", "AT", "TO", "FOR", "BY", "WITH"]
# ordered (any of these, then ordered refinements, default) rules of the simplified class chart
CLASS_CHART_RULES = [
    (["wine", "champagne"],
     [(["dessert", "port", "sherry"], "Dessert Wine"), (["sparkling", "champagne"], "Sparkling Wine"),
      (["red"], "Red Wine"), (["white"], "White Wine"), (["rose"], "Rosé Wine"), (["table"], "Table Wine")],
     "Wine"),
    (["whiskey", "whisky", "bourbon"],
     [(["scotch"], "Scotch Whisky"), (["bourbon"], "Bourbon Whiskey"), (["rye"], "Rye Whiskey"),
      (["corn"], "Corn Whiskey")], "Whiskey"),
    (["beer", "ale", "stout", "malt"],
     [(["near beer", "non alcoholic"], "Non-Alcoholic Beer")], "Beer & Malt Beverages"),
    (["vodka"], [], "Vodka"),
    (["rum"], [], "Rum"),
    (["gin"], [], "Gin"),
    (["brandy", "cognac", "armagnac", "pisco", "grappa"],
     [(["apple"], "Apple Brandy"), (["cognac"], "Cognac")], "Brandy"),
    (["tequila", "mezcal", "agave"], [(["mezcal"], "Mezcal")], "Tequila"),
    (["liqueur", "cordial"],
     [(["coffee", "cafe"], "Coffee Liqueur"), (["fruit"], "Fruit Liqueurs"),
      (["herb", "seed"], "Herbal Liqueurs")], "Liqueurs"),
    (["sake"], [], "Sake"),
    (["vermouth"], [], "Vermouth"),
    (["bitters"], [], "Bitters"),
    (["cocktail"], [], "Cocktails"),
    (["sambuca"], [], "Sambuca"),
]

# --- fixed values: brand names -----------------------------------------------------------------
STORE_BRANDS = [
    "KIRKLAND", "KIRKLAND SIGNATURE", "COSTCO", "KROGER", "KROGER SELECT", "SIMPLE TRUTH", "SAFEWAY",
    "LUCERNE", "O ORGANICS", "WALMART", "GREAT VALUE", "EQUATE", "TARGET", "GOOD & GATHER", "EVERSPRING",
    "TRADER JOES", "TRADER JOE", "TJS", "WHOLE FOODS", "365", "WHOLE FOODS MARKET", "ALDI",
    "SIMPLY NATURE", "LIVEWELL", "WEGMANS", "WEIS", "GIANT", "STOP & SHOP",
]
PRIVATE_LABEL_TERMS = [
    "PRIVATE LABEL", "STORE BRAND", "HOUSE BRAND", "EXCLUSIVE", "SIGNATURE", "SELECT", "CHOICE",
    "PREMIUM", "FINEST", "BEST", "VALUE",
]
PROPOSAL_WHITE_LABELS = ["KIRKLAND", "KROGER", "WALMART", "TARGET", "COSTCO", "TRADER", "WHOLE FOODS"]
PROPOSAL_CONTRACT_STORES = ["KIRKLAND", "KROGER", "WALMART", "TARGET", "COSTCO"]
PRODUCT_TERMS = {
    "tequila": ["BLANCO", "REPOSADO", "ANEJO", "EXTRA ANEJO", "CRISTALINO", "JOVEN", "PLATA", "GOLD",
                "SILVER", "ADDITIVE FREE", "ORGANIC"],
    "whiskey": ["SINGLE BARREL", "CASK STRENGTH", "BARREL PROOF", "STRAIGHT", "BOURBON", "RYE", "WHEAT",
                "BOTTLED IN BOND", "SMALL BATCH", "SINGLE MALT", "RESERVE", "SELECT",
                "KENTUCKY STRAIGHT", "TENNESSEE", "CANADIAN", "IRISH", "SCOTCH", "BLENDED"],
    "vodka": ["PREMIUM", "ULTRA", "PURE", "ORIGINAL", "CLASSIC", "PLATINUM", "ORGANIC", "GLUTEN FREE",
              "FILTERED", "DISTILLED"],
    "gin": ["LONDON DRY", "PLYMOUTH", "OLD TOM", "NAVY STRENGTH", "CONTEMPORARY", "BOTANICAL", "PREMIUM",
            "CRAFT"],
    "rum": ["WHITE", "SILVER", "GOLD", "DARK", "SPICED", "AGED", "PREMIUM", "RESERVE", "CAPTAIN",
            "ADMIRAL"],
    "wine": ["CABERNET", "CHARDONNAY", "PINOT NOIR", "SAUVIGNON", "MERLOT", "ZINFANDEL", "ROSE", "BLANC",
             "ROUGE", "RESERVE", "ESTATE", "VINTAGE", "DESSERT", "ICE WINE", "PORT", "SHERRY"],
    "general": ["RESERVE", "LIMITED EDITION", "RELEASE", "VINTAGE", "ESTATE", "SELECT", "PREMIUM",
                "SPECIAL", "COLLECTION", "SERIES", "EXTRA", "ULTRA", "SUPER", "FINEST", "ORIGINAL",
                "CLASSIC", "SIGNATURE", "ARTISAN", "CRAFT", "HANDCRAFTED", "SMALL BATCH"],
    "size_volume": ["LITER", "ML", "750", "1.75", "375", "50ML", "100ML", "200ML", "MAGNUM",
                    "DOUBLE MAGNUM", "SPLIT", "HALF BOTTLE", "MINI"],
}
AGE_PATTERNS = [
    r"\d{1,2}\s*YEAR(?:S)?(?:\s+OLD)?", r"\d{1,2}\s*YR(?:S)?(?:\s+OLD)?", r"\d{1,2}\s*YO",
    r"\d{1,2}\s*ANOS?", r"AGED\s+\d{1,2}\s*YEAR(?:S)?",
]
PROOF_PATTERNS = [
    r"\d{2,3}(?:\.\d)?\s*PROOF", r"\d{1,2}(?:\.\d)?\s*%\s*ABV?", r"\d{2,3}°", "BARREL PROOF",
    "CASK STRENGTH", "NAVY STRENGTH",
]
# tried in this order; group 1 of the first hit is the core name
CORE_NAME_PATTERNS = [
    r"([A-Z\s]+)'S\s+", r"([A-Z\s]+)S'\s+",
    r"([A-Z\s]+)\s+(?:COMPANY|CORP|LLC|INC|LTD)(?:\s|$)",
    r"([A-Z\s]+)\s+DISTILLERY(?:\s|$)",
    r"([A-Z\s]+)\s+BREW(?:ERY|ING)(?:\s|$)",
    r"([A-Z\s]+)\s+WIN(?:ERY|ES)(?:\s|$)",
    r"([A-Z\s]+)\s+(?:NO\.?\s*)?\d+(?:\s|$)",
]
UPPERCASE_WORDS = ["G4", "XO", "VS", "VSOP", "USA", "UK", "TTB", "LLC", "INC", "CO"]
BUSINESS_WORDS = r"\b(LLC|INC|CORP|COMPANY|CO\.|BREWING|WINERY|DISTILLERY)\b"
PRODUCT_INDICATORS = [
    "oz", "ml", "liter", "gallon", "12oz", "16oz", "750ml",
    "freedom", "barrel aged", "reserve", "special edition", "limited", "single malt", "double ipa",
    "imperial", "vintage", "estate",
    r"\d{4}",  # compared as a literal, so it never matches
    "château", "cuvée", "réserve", "grand cru", "premier cru",
    "pale ale", "ipa", "stout", "porter", "lager", "pilsner", "witbier", "wheat beer", "hefeweizen",
    "saison", "gose", "sour", "belgian style", "american style", "english style", "german style",
    "double", "triple", "quadruple", "barleywine", "amber", "blonde",
]
PRODUCT_CLASS_TERMS = ["ale", "beer", "wine", "whiskey", "vodka"]
COMPANY_INDICATORS = [
    "brewing", "brewery", "winery", "distillery", "spirits", "wine company", "cellars", "vineyards",
    "estates", "company", "corp", "corporation", "inc", "llc", "ltd", "& co", "and company", "brothers",
    "family",
]
DOMAIN_TRADE_SUFFIXES = ["brewing", "brewery", "winery", "wines", "spirits", "distillery", "company", "co", "inc"]
TRAILING_TRADE_SUFFIXES = [
    " wines", " wine", " spirits", " distillery", " brewery", " vineyards", " vineyard", " estates",
    " estate", " cellars", " cellar", " & co", " co.", " inc", " llc",
]
NAME_ABBREVIATIONS = {
    "company": ["co", "comp"], "corporation": ["corp"], "incorporated": ["inc"], "limited": ["ltd"],
    "distillery": ["dist", "distilleries"], "brewery": ["brew", "brewing", "breweries"],
    "winery": ["wine", "wines", "vineyard", "vineyards"], "spirits": ["spirit"], "whiskey": ["whisky"],
    "vodka": ["vodkas"], "and": ["&", "n"],
}
BRAND_SUFFIXES = {
    "distillery": 0.9, "distilleries": 0.9, "brewery": 0.9, "brewing": 0.9, "winery": 0.9, "vineyard": 0.9,
    "spirits": 0.85, "whiskey": 0.8, "bourbon": 0.8, "vodka": 0.8, "gin": 0.8, "rum": 0.8, "tequila": 0.8,
    "mezcal": 0.8,
}
LOCATION_WORDS = [
    "california", "kentucky", "tennessee", "texas", "oregon", "washington", "new york", "colorado", "virginia",
]
YEAR_PATTERN = r"\b(18|19|20)\d{2}\b"
EDITION_PATTERN = r"\b(limited|special|reserve|edition|select)\b"
PRODUCER_WEIGHTS = {
    "primary_producer": 1.0, "secondary_producer": 0.8, "former_producer": 0.3, "contract_producer": 0.9,
    "unknown_producer": 0.1,
}
CONFIDENCE_SAME_PRODUCER, CONFIDENCE_NAME_ONLY = 0.95, 0.50
VARIATION_SCORES = {
    "exact": 1.0, "year_variation": 0.95, "location_variation": 0.9, "suffix_variation": 0.85,
    "abbreviation": 0.8, "special_edition": 0.85,
}

# --- fixed values: web results -----------------------------------------------------------------
INDUSTRY_WEIGHTS = {
    "distillery": 0.8, "brewery": 0.8, "winery": 0.8, "vineyard": 0.7, "cellar": 0.6, "distilling": 0.7,
    "brewing": 0.7, "winemaking": 0.7,
    "whiskey": 0.6, "whisky": 0.6, "bourbon": 0.6, "scotch": 0.6, "vodka": 0.6, "gin": 0.6, "rum": 0.6,
    "tequila": 0.6, "mezcal": 0.6, "brandy": 0.6, "cognac": 0.6, "wine": 0.5, "beer": 0.5, "spirits": 0.6,
    "liquor": 0.5, "liqueur": 0.5,
    "barrel": 0.4, "aged": 0.4, "craft": 0.4, "small batch": 0.5, "single malt": 0.5, "fermented": 0.4,
    "distilled": 0.5, "matured": 0.4, "cask": 0.4, "proof": 0.4,
    "producer": 0.3, "manufacturer": 0.3, "maker": 0.3, "company": 0.2, "brand": 0.2,
}
NEGATIVE_WEIGHTS = {
    "facebook": -1.0, "instagram": -1.0, "twitter": -1.0, "linkedin": -1.0, "pinterest": -1.0,
    "tiktok": -1.0, "youtube": -1.0, "reddit": -1.0,
    "forum": -1.0, "discussion": -1.0, "thread": -1.0, "comment": -1.0, "review": -0.8, "rating": -0.8,
    "board": -1.0, "community": -0.9, "talk": -0.9, "chat": -0.9,
    "whiskybase": -1.0, "whiskyforum": -1.0, "connosr": -1.0, "straightbourbon": -1.0,
    "distillerytrail": -0.9, "cocktailtimes": -0.9, "spiritsreview": -0.9,
    "amazon": -1.0, "ebay": -1.0, "walmart": -1.0, "shop": -0.6, "store": -0.6, "buy": -0.6, "price": -0.7,
    "deal": -0.8, "discount": -0.8, "marketplace": -0.9,
    "wikipedia": -0.8, "wiki": -0.8, "encyclopedia": -0.8, "dictionary": -0.9, "definition": -0.8,
    "news": -0.5, "article": -0.4, "blog": -0.6, "magazine": -0.4,
}
BLOCKED_DOMAINS = [
    "reddit.com", "facebook.com", "instagram.com", "twitter.com", "linkedin.com", "pinterest.com",
    "tiktok.com", "youtube.com",
    "whiskybase.com", "connosr.com", "straightbourbon.com", "whiskyforum.com", "bourbonforum.com",
    "scotchwhisky.com", "cocktaildb.com", "drinkspirit.com", "spiritreview.com", "maltmadness.com",
    "whiskycast.com", "distillerytrail.com",
    "amazon.com", "ebay.com", "walmart.com", "target.com", "totalwine.com", "wine.com", "drizly.com",
    "reservebar.com",
    "wikipedia.org", "wiki.com", "fandom.com", "tripadvisor.com", "yelp.com", "foursquare.com",
    "buzzfeed.com", "mashable.com", "huffpost.com",
]
FORUM_WORDS = ["forum", "board", "discussion", "community", "talk"]
FAST_BLOCKED_DOMAINS = [
    "reddit.com", "facebook.com", "instagram.com", "twitter.com", "linkedin.com", "wikipedia.org",
    "yelp.com", "tripadvisor.com", "pinterest.com", "youtube.com", "tiktok.com", "snapchat.com",
    "amazon.com", "ebay.com", "walmart.com", "google.com", "bing.com",
]
OFFICIAL_WEIGHTS = {
    "official website": 1.0, "official site": 1.0, "homepage": 0.8, "welcome to": 0.7, "about us": 0.5,
    "our story": 0.6, "our distillery": 0.8, "our brewery": 0.8, "our winery": 0.8, "founded": 0.4,
    "established": 0.4, "since": 0.3, "family owned": 0.5, "award winning": 0.4, "premium": 0.3,
    "handcrafted": 0.4, "artisan": 0.4,
}
VISIT_WEIGHTS = {
    "visit us": 0.6, "location": 0.4, "tours": 0.5, "tasting room": 0.7, "visitor center": 0.6,
    "open hours": 0.5, "directions": 0.4,
}
GATE_PRODUCTS = [
    "whiskey", "whisky", "bourbon", "scotch", "rye", "tennessee whiskey", "irish whiskey", "irish whisky",
    "vodka", "gin", "rum", "tequila", "mezcal", "brandy", "cognac", "wine", "beer", "ale", "lager", "stout",
    "ipa", "spirits", "liquor", "liqueur",
]
GATE_FACILITIES = [
    "distillery", "distilleries", "distilling", "distiller", "brewery", "breweries", "brewing", "brewer",
    "brewhouse", "winery", "wineries", "winemaker", "vineyard", "vintner",
]
GATE_EXTRA_FACILITIES = ["cellar", "estate", "château", "chateau"]
GATE_WORD_PRODUCTS = [
    "whiskey", "whisky", "bourbon", "scotch", "rye", "tennessee", "vodka", "gin", "rum", "tequila", "mezcal",
    "brandy", "cognac", "wine", "beer", "ale", "lager", "stout", "ipa", "spirits", "liquor", "liqueur",
]
SUSPICIOUS_TLDS = [".tk", ".ml", ".ga", ".cf"]
# (any of these in the class types, text terms that then count), tried in order
CLASS_CONTEXT_TERMS = [
    (["whiskey", "whisky", "bourbon", "rye", "scotch"],
     ["whiskey", "whisky", "bourbon", "scotch", "rye", "tennessee", "irish"]),
    (["wine"], ["wine", "winery", "vineyard", "vintner", "cellar", "estate", "château"]),
    (["beer", "ale", "lager", "stout"],
     ["beer", "brewery", "brewing", "ale", "lager", "stout", "ipa", "pilsner"]),
    (["vodka"], ["vodka", "premium vodka", "craft vodka", "potato vodka", "wheat vodka"]),
    (["gin"], ["gin", "dry gin", "london gin", "craft gin", "botanical"]),
]
REGION_TERMS = [
    (["scotland", "united kingdom"], ["scottish", "highland", "lowland", "speyside", "islay"], 0.25),
    (["ireland"], ["irish", "dublin", "cork", "jameson"], 0.25),
    (["united states", "usa"], ["kentucky", "tennessee", "bourbon trail", "american"], 0.2),
]
HERITAGE_TERMS = ["established", "since", "founded", "heritage"]
SCORE_WEIGHTS = {"domain": 0.30, "brand_match": 0.25, "industry": 0.20, "official": 0.15, "negative": 0.10,
                 "context": 0.10}
FAST_INDUSTRY_TERMS = [
    "distillery", "brewery", "winery", "spirits", "whiskey", "vodka", "gin", "rum", "wine", "beer",
]
FAST_BAD_TERMS = ["reddit", "facebook", "instagram", "wikipedia", "forum", "discussion", "review"]
FAST_LISTING_TERMS = ["list", "directory", "guide", "top10", "best"]
LEGACY_SPIRIT_TERMS = [
    "spirits", "distillery", "whiskey", "vodka", "gin", "rum", "bourbon", "wine", "brewery",
]
RELEVANCE_TERMS = [
    "whiskey", "whisky", "bourbon", "distillery", "spirits", "brewery", "brewing", "brewer", "wine", "winery",
    "vineyard", "vodka", "rum", "gin", "tequila", "mezcal", "liqueur", "liquor", "alcohol", "alcoholic",
    "beverage", "drinks", "scotch", "rye", "brandy", "cognac", "proof", "beer", "ale", "lager", "stout",
    "ipa", "craft", "tap", "taproom", "bar", "pub", "cocktail", "bottle", "barrel", "cask", "aged",
    "fermented", "distilled", "premium", "reserve", "vintage",
]
RELEVANCE_DOMAIN_TERMS = [
    "distillery", "brewery", "winery", "spirits", "wine", "whiskey", "vodka", "gin", "rum", "beer", "brewing",
]
RELEVANCE_AVOID = [
    "wikipedia", "history museum", "historical society", "archive.org", "biography.com", "encyclopedia",
    "timeline of", "born in", "died in", "medieval", "ancient", "15th century", "16th century", "civil war",
]
SKIP_TITLE_TERMS = [
    "wikipedia", "wiki", "century", "history", "13th century", "medieval", "middle ages", "historical",
    "facts about", "events in", "what happened in", "archives", "timeline", "encyclopedia", "biographical",
    "birth", "death",
]
SURVIVOR_TITLE_TERMS = [
    "whiskey", "whisky", "bourbon", "distillery", "spirits", "brewery", "wine", "vodka", "rum", "gin",
    "tequila", "liqueur", "alcohol", "beverage", "drinks",
]
HISTORY_DOMAINS = [
    "onthisday.com", "history.com", "ohmyfacts.com", "eventshistory.com", "wikipedia.org", "bing.com",
    "timeanddate.com", "thisdayinhistory.com", "britannica.com", "famousbirthdays.com",
]
HISTORY_PATHS = ["events/date", "history", "facts-about", "timeline", "archives"]
SURVIVOR_CONTENT_TERMS = [
    "distillery", "bourbon", "whiskey", "whisky", "spirits", "brewery", "wine", "beer", "ale", "lager",
]
MISMATCH_SPIRIT_CLASSES = ["VODKA", "WHISKY", "RUM", "GIN", "TEQUILA"]
MISMATCH_WINE_DOMAINS = ["wine", "vino", "vineyard"]
MISMATCH_SPIRIT_DOMAINS = ["vodka", "whisky", "whiskey", "rum", "gin", "tequila", "spirits", "distill"]
PERSON_PATTERNS = [
    r"(?i)(?:founder|ceo|owner|president|proprietor)(?:\s+and\s+\w+)?[\s:]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})[\s,]+(?:founder|ceo|owner|president)",
    r"(?i)(?:founded\s+by|established\s+by|created\s+by|started\s+by)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
    r"(?i)(?:master\s+)?(?:distiller|winemaker|brewmaster|vintner)[\s:]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})",
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}),?\s+(?:master\s+)?(?:distiller|winemaker|brewmaster)",
    r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\s+(?:founded|established|started|launched)\s+(?:the\s+)?(?:company|distillery|winery|brewery)",
]
# a text can match the pattern at the same position only if it holds one of these words
PERSON_KEYWORDS = [
    ["founder", "ceo", "owner", "president", "proprietor"],
    ["founder", "ceo", "owner", "president"],
    ["founded", "established", "created", "started"],
    ["distiller", "winemaker", "brewmaster", "vintner"],
    ["distiller", "winemaker", "brewmaster"],
    ["founded", "established", "started", "launched"],
]
NAME_SUFFIXES = ["Jr", "Sr", "III", "II", "PhD", "MD"]
NAME_COMPANY_WORDS = [
    "Inc", "LLC", "Ltd", "Company", "Corporation", "Distillery", "Winery", "Brewery", "Group",
]
EXECUTIVE_TITLES = [
    "founder", "co-founder", "owner", "co-owner", "ceo", "president", "chief executive", "managing director",
    "proprietor", "distiller", "master distiller", "head distiller", "winemaker", "head winemaker", "vintner",
    "brewmaster", "head brewer", "brewing director",
]
COMPANY_INDUSTRY_TERMS = ["wine", "spirit", "alcohol", "beverage", "import", "distribution"]

# --- fixed values: feedback learning -----------------------------------------------------------
INDUSTRY_KEYWORDS = [
    "spirits", "distillery", "whiskey", "bourbon", "vodka", "gin", "rum", "tequila", "wine", "brewery", "winery",
]
FEATURE_KEYWORDS = ["spirits", "distillery", "whiskey", "bourbon", "vodka", "gin", "rum", "wine", "brewery"]
SOCIAL_WORDS = ["facebook", "instagram", "twitter", "linkedin"]
MARKET_WORDS = ["amazon", "ebay", "walmart"]
SEARCH_TERMS = ["official website", "distillery", "spirits", "company"]
FALSE_POSITIVE_DOMAINS = [
    "facebook", "instagram", "twitter", "linkedin", "wikipedia", "yelp", "tripadvisor", "google", "bing",
    "yahoo", "amazon", "reddit", "pinterest", "youtube", "tiktok", "snapchat",
]
DESCRIPTOR_PATTERNS = [
    r"\b(\w+)\s+(?:spirits?|liquor|alcohol)\b",
    r"\b(?:artisan|craft|premium|small batch|handcrafted)\s+(\w+)\b",
    r"\b(\w+)(?:ed|ing)?\s+(?:in|with|from)\s+(?:barrels?|casks?|oak)\b",
    r"\b(?:single|double|triple)\s+(\w+)\b",
    r"\b(\w+)\s+(?:variety|style|blend)\b",
]
FACILITY_PATTERNS = [
    r"\b(\w+house)\b",
    r"\b(\w+)\s+(?:facility|operation|company)\b",
    r"\b(?:the\s+)?(\w+)\s+(?:estate|manor|farm)\b",
]
REJECTION_PATTERNS = [
    r"\b(restaurant|hotel|bar|pub|club)\b", r"\b(review|rating|blog|news)\b",
    r"\b(job|career|hiring|employment)\b", r"\b(consulting|marketing|design|software)\b",
    r"\b(real estate|finance|insurance)\b", r"\b(facebook|instagram|twitter|linkedin|social)\b",
]
COMMON_STARTS = ["a ", "the ", "an ", "and ", "or "]
STRATEGY_SPIRIT_WORDS = ["whiskey", "bourbon", "vodka", "gin", "rum", "spirits"]
STRATEGY_BEER_WORDS = ["beer", "ale", "malt", "brewery"]
PATTERN_SUCCESS_STEP = 0.05
PATTERN_MIN_SAMPLES, TERM_MIN_SAMPLES, CALIBRATION_MIN_SAMPLES = 3, 2, 5

# --- fixed values: upload headers --------------------------------------------------------------
REQUIRED_LABEL_COLUMNS = ["Permit No.", "Brand Name", "TTB ID"]
IMPORTANT_LABEL_COLUMNS = ["Class Type", "Class Type Desc", "Origin Desc"]
LABEL_COLUMN_ALIASES = {
    "Permit No.": ["permit", "permit_no", "permit_number", "permitno"],
    "Brand Name": ["brand", "brand_name", "brandname", "name"],
    "TTB ID": ["ttb", "ttb_id", "ttbid", "id"],
    "Class Type": ["class/type", "class_type", "alcohol_class", "type_code"],
    "Class Type Desc": ["class_type_desc", "alcohol_type", "beverage_type", "class/type desc", "class/type_desc"],
    "Origin Desc": ["origin", "country", "origin_desc", "location"],
}
CONTACT_COLUMN_ALIASES = {
    "brand_name": ["brand_name", "company_name", "company"],
    "contact_name": ["contact_name", "full_name", "full name"],
    "email": ["email"],
    "title": ["job_title", "job title", "title"],
    "linkedin": ["linkedin"],
    "department": ["department"],
    "seniority": ["seniority"],
    "website": ["website", "domain"],
}
REQUIRED_CONTACT_COLUMNS = ["brand_name", "contact_name", "email", "title"]
# tried in order; the second accepts every byte, so no later one is ever reached
TEXT_ENCODINGS = ["utf-8", "iso-8859-1"]
DELIMITERS = [",", ";", "\t", "|"]
