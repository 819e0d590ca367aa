"""Word lists, patterns and constants that define the results."""

# Fixed value: upper-case words that look like symbols but never are.
SYMBOL_STOPWORDS = (
    "A", "ABER", "AI", "ALL", "AN", "AND", "API", "AS", "ASAP", "ATH", "B", "BBQ", "BE",
    "CEO", "CFO", "CPI", "CPU", "DD", "DE", "DM", "DNA", "DT", "ES", "ETF", "EU", "EV",
    "FED", "FOMO", "FOR", "GDP", "IF", "IHR", "IMO", "IPO", "IRS", "IT", "LOL", "LONG",
    "MOON", "NEED", "NOW", "OTC", "PM", "PUMP", "QQQ", "SEC", "SOME", "SOON", "SPAC",
    "THE", "TLDR", "TO", "USA", "USD", "WSB", "YOLO", "YOU",
)

# Fixed value: single-word company suffixes stripped from the end of a name.
CORPORATE_SUFFIXES = (
    "ab", "ag", "asa", "co", "company", "corp", "corporation", "group", "holding",
    "holdings", "inc", "incorporated", "limited", "ltd", "nv", "oyj", "plc", "sa", "se", "spa",
)

# Fixed value: suffixes dropped anywhere in a security-master name.
MASTER_SUFFIXES = (
    "ag", "co", "company", "corp", "corporation", "group", "holding", "holdings", "inc",
    "ltd", "nv", "plc", "sa", "se",
)

# Fixed value: base lexicon, trading slang in English and German.
KEYWORD_SCORES = {
    "long": 1, "call": 1, "bull": 1, "bullish": 1, "buy": 1, "kaufen": 1, "kauf": 1,
    "bullisch": 1, "moon": 1, "pump": 1, "yolo": 1, "fomo": 1, "hodl": 1, "btfd": 1,
    "rocket": 1, "squeeze": 1, "lfg": 1, "hoch": 1, "lambo": 1, "🚀": 1, "green": 1,
    "grün": 1, "profit": 1, "gewinn": 1, "rally": 1, "boom": 1,
    "short": -1, "put": -1, "bear": -1, "bearish": -1, "sell": -1, "verkaufen": -1,
    "bärisch": -1, "dip": -1, "dump": -1, "dumping": -1, "fud": -1, "crash": -1,
    "bagholder": -1, "rekt": -1, "down": -1, "fall": -1, "sink": -1, "stupid": -1,
    "schlecht": -1, "red": -1, "rot": -1, "loss": -1, "verlust": -1, "collapse": -1,
    "baisse": -1,
}

# Fixed value: general words that extend the base lexicon.
EXTRA_KEYWORD_SCORES = {
    "abandon": -1, "abnormal": -1, "abolish": -1, "absturz": -1, "abundance": 1,
    "accident": -1, "accomplish": 1, "achieve": 1, "advantage": 1, "bankrupt": -1,
    "bedrohung": -1, "begeistert": 1, "benefit": 1, "betrug": -1, "caution": -1,
    "chance": 1, "danger": -1, "enttäuscht": -1, "erfolg": 1, "erfolgreich": 1,
    "fail": -1, "fantastisch": 1, "gefahr": -1, "glücklich": 1, "grandios": 1,
    "growth": 1, "günstig": 1, "improve": 1, "katastrophe": -1, "liability": -1,
    "opportunity": 1, "pleite": -1, "profitability": 1, "risk": -1, "schwach": -1,
    "success": 1, "traurig": -1, "uncertain": -1, "upturn": 1, "verlustreich": -1,
    "versagen": -1, "vorteilhaft": 1, "wohlstand": 1, "zufrieden": 1, "überragend": 1,
}

# Fixed value: words that multiply the following keyword.
INTENSITY_WEIGHTS = {
    "strong": 2, "massiv": 2, "extrem": 2, "mega": 2, "super": 2, "über": 2,
}

# Fixed value: words that negate a keyword among the next two tokens.
NEGATION_MARKERS = ("nicht", "kein", "no", "not", "nie", "ohne")

# Fixed value: word boosts on top of a model score, and their clamp.
WORD_BOOSTS = {"long": 0.2, "call": 0.2, "short": -0.2, "put": -0.2}
WORD_BOOST_LIMIT = 0.4

# Fixed value: symbol patterns (Java regular expressions).
FREE_CASHTAG = r"(?i)(?<![A-Za-z0-9])[#$]\s*([A-Za-z][A-Za-z0-9.\-]{0,9})(?![A-Za-z0-9])"
PREFIX_CASHTAG = r"(?i)(?<![A-Za-z0-9])[#$]\s*([A-Za-z][A-Za-z0-9.\-]{0,9})"
PLAIN_SYMBOL = r"(?<![A-Za-z0-9])([A-Z][A-Z0-9]{1,4}(?:\.[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"

# Fixed value: field lengths and caps of the post tables.
ENRICHED_TEXT_CHARS = 4096
BUCKET_TEXT_CHARS = 2000
BUCKET_POSTS = 100
UPVOTE_CAP = 10_000_000

# Fixed value: default rules of the automatic watchlist.
WATCHLIST_RULES = ".*.DE:15:2.5,DEFAULT:25:3.5"

# Fixed value: threshold grids of the classifier calibration.
F1_GRID = (0.2, 0.8, 25)
DUAL_GRID = (0.25, 0.75, 21)

# Fixed value: parameters that the search of each per-symbol model tries.
MODEL_GRIDS = {
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [3, 5, None]},
    "gradient_boosting": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5]},
}
