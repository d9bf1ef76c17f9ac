"""Word lists, lookup tables, patterns and thresholds.

Everything in this module is data. The values decide the results, so they are
stated as they are, in their natural order.
"""

# --- legal suffixes by region ------------------------------------------------
SUFFIXES = {
    "us": [
        "Inc", "Inc.", "Incorporated", "Corp", "Corp.", "Corporation", "Co", "Co.", "Company",
        "LLC", "L.L.C.", "Limited Liability Company", "LP", "L.P.", "Limited Partnership",
        "LLP", "L.L.P.", "Limited Liability Partnership", "Ltd", "Ltd.", "Limited",
        "PC", "P.C.", "Professional Corporation", "PA", "P.A.", "Professional Association",
        "PLLC", "P.L.L.C.", "Professional Limited Liability Company",
    ],
    "uk": [
        "Ltd", "Ltd.", "Limited", "PLC", "P.L.C.", "Public Limited Company",
        "LLP", "L.L.P.", "Limited Liability Partnership",
    ],
    "europe": [
        "AG", "A.G.", "Aktiengesellschaft", "GmbH", "G.m.b.H.",
        "Gesellschaft mit beschränkter Haftung", "SA", "S.A.", "Société Anonyme",
        "SARL", "S.A.R.L.", "Société à responsabilité limitée", "BV", "B.V.",
        "Besloten Vennootschap", "NV", "N.V.", "Naamloze Vennootschap", "SpA", "S.p.A.",
        "Società per Azioni", "AB", "A.B.", "Aktiebolag", "AS", "A.S.", "Aksjeselskap",
        "Oy", "Oyj",
    ],
    "asia": [
        "KK", "K.K.", "Kabushiki Kaisha", "株式会社", "YK", "Y.K.", "Yugen Kaisha", "有限会社",
        "Pte Ltd", "Pte. Ltd.", "Private Limited", "Sdn Bhd", "Sdn. Bhd.", "Sendirian Berhad",
        "Co., Ltd.", "有限公司", "股份有限公司",
    ],
    "other": [
        "Group", "Groups", "Holdings", "Holding", "International", "Intl", "Intl.", "Global",
        "Worldwide", "Partners", "Associates", "Enterprises", "Ventures", "Technologies", "Tech",
        "Solutions", "Services", "Systems", "Industries",
    ],
}

SUFFIX_TYPES = {
    "corporation": ["inc", "inc.", "incorporated", "corp", "corp.", "corporation"],
    "limited_liability_company": ["llc", "l.l.c.", "limited liability company"],
    "limited_company": ["ltd", "ltd.", "limited"],
    "public_limited_company": ["plc", "p.l.c.", "public limited company"],
    "limited_partnership": ["lp", "l.p.", "limited partnership"],
    "limited_liability_partnership": ["llp", "l.l.p.", "limited liability partnership"],
}

# country hints that do not follow from the us / uk lists above
SUFFIX_COUNTRIES = {
    "ag": ["DE", "CH"], "a.g.": ["DE", "CH"], "gmbh": ["DE"], "g.m.b.h.": ["DE"],
    "sa": ["FR"], "s.a.": ["FR"], "sarl": ["FR"], "s.a.r.l.": ["FR"],
    "bv": ["NL"], "b.v.": ["NL"], "nv": ["NL"], "n.v.": ["NL"],
    "spa": ["IT"], "s.p.a.": ["IT"], "ab": ["SE"], "a.b.": ["SE"],
    "as": ["NO"], "a.s.": ["NO"], "oy": ["FI"], "oyj": ["FI"],
    "kk": ["JP"], "k.k.": ["JP"], "yk": ["JP"], "y.k.": ["JP"],
    "pte ltd": ["SG"], "pte. ltd.": ["SG"], "sdn bhd": ["MY"], "sdn. bhd.": ["MY"],
}

ABBREVIATIONS = {
    "IBM": "International Business Machines", "GM": "General Motors", "GE": "General Electric",
    "P&G": "Procter & Gamble", "J&J": "Johnson & Johnson",
    "AT&T": "American Telephone & Telegraph", "UPS": "United Parcel Service",
    "FedEx": "Federal Express", "BMW": "Bayerische Motoren Werke",
    "HSBC": "Hongkong and Shanghai Banking Corporation", "KPMG": "Klynveld Peat Marwick Goerdeler",
    "PwC": "PricewaterhouseCoopers", "EY": "Ernst & Young", "CVS": "Consumer Value Stores",
    "IKEA": "Ingvar Kamprad Elmtaryd Agunnaryd",
}

VARIATIONS = {
    "alphabet": ["google", "alphabet inc"],
    "meta": ["facebook", "meta platforms"],
    "x": ["twitter", "x corp"],
    "salesforce": ["salesforce.com"],
    "walmart": ["wal-mart"],
    "exxonmobil": ["exxon mobil", "exxon", "mobil"],
    "jpmorgan": ["jp morgan", "jpmorgan chase", "chase"],
    "berkshire hathaway": ["berkshire"],
    "procter gamble": ["p&g", "procter and gamble"],
    "johnson johnson": ["j&j", "johnson and johnson"],
}

# --- fuzzy matching ----------------------------------------------------------
STOP_WORDS = [
    "the", "and", "of", "in", "for", "a", "an", "&", "company", "corporation", "incorporated",
    "limited", "corp", "inc", "ltd", "llc", "co",
]
ABBREVIATION_PAIRS = [
    ("intl", "international"), ("corp", "corporation"), ("inc", "incorporated"),
    ("ltd", "limited"), ("co", "company"), ("assoc", "associates"), ("mgmt", "management"),
    ("svcs", "services"), ("tech", "technologies"), ("pharm", "pharmaceutical"),
    ("mfg", "manufacturing"),
]
ABBREVIATION_BONUS = 0.1
RATIO_WEIGHTS = {"ratio": 0.2, "partial": 0.2, "tokenSort": 0.3, "tokenSet": 0.3}
SCORE_LABELS = [(0.95, "very_high"), (0.85, "high"), (0.75, "medium"), (0.65, "low")]

# --- knowledge base ----------------------------------------------------------
# id, name, aliases, ticker, exchange, industry, type, subsidiaries, previous names
KB_COMPANIES = [
    ("apple", "Apple Inc.", ["Apple", "Apple Computer", "Apple Computer Inc.", "AAPL"],
     "AAPL", "NASDAQ", "Technology", "corporation", [], []),
    ("microsoft", "Microsoft Corporation", ["Microsoft", "Microsoft Corp.", "MSFT"],
     "MSFT", "NASDAQ", "Technology", "corporation", [], []),
    ("alphabet", "Alphabet Inc.", ["Alphabet", "Google", "Google Inc.", "GOOGL", "GOOG"],
     "GOOGL", "NASDAQ", "Technology", "corporation", ["Google", "YouTube", "Waymo"], []),
    ("amazon", "Amazon.com Inc.", ["Amazon", "Amazon.com", "AMZN"],
     "AMZN", "NASDAQ", "E-commerce/Cloud", "corporation", [], []),
    ("meta", "Meta Platforms Inc.", ["Meta", "Facebook", "Facebook Inc.", "FB", "META"],
     "META", "NASDAQ", "Technology", "corporation", [], ["Facebook Inc."]),
    ("berkshire", "Berkshire Hathaway Inc.", ["Berkshire Hathaway", "Berkshire", "BRK.A", "BRK.B"],
     "BRK.A", "NYSE", "Conglomerate", "corporation", [], []),
    ("jpmorgan", "JPMorgan Chase & Co.", ["JPMorgan", "JP Morgan", "JPMorgan Chase", "Chase", "JPM"],
     "JPM", "NYSE", "Banking", "corporation", [], []),
    ("walmart", "Walmart Inc.", ["Walmart", "Wal-Mart", "Wal-Mart Stores", "WMT"],
     "WMT", "NYSE", "Retail", "corporation", [], []),
    ("tesla", "Tesla Inc.", ["Tesla", "Tesla Motors", "TSLA"],
     "TSLA", "NASDAQ", "Automotive/Energy", "corporation", [], []),
    ("nvidia", "NVIDIA Corporation", ["NVIDIA", "Nvidia", "NVDA"],
     "NVDA", "NASDAQ", "Technology", "corporation", [], []),
]
CANDIDATE_BOOST = {"name": 1.0, "alias": 0.9, "ticker": 0.8}

# name, aliases, ticker, sector
KNOWN_ENTITIES = [
    ("Apple Inc.", ["Apple", "AAPL"], "AAPL", "technology"),
    ("Microsoft Corporation", ["Microsoft", "MSFT"], "MSFT", "technology"),
    ("Alphabet Inc.", ["Google", "Alphabet", "GOOGL", "GOOG"], "GOOGL", "technology"),
    ("Amazon.com Inc.", ["Amazon", "AMZN"], "AMZN", "technology"),
    ("Meta Platforms Inc.", ["Facebook", "Meta", "FB", "META"], "META", "technology"),
    ("JPMorgan Chase & Co.", ["JPMorgan", "Chase", "JPM"], "JPM", "finance"),
    ("Bank of America Corporation", ["Bank of America", "BofA", "BAC"], "BAC", "finance"),
    ("Wells Fargo & Company", ["Wells Fargo", "WFC"], "WFC", "finance"),
    ("Goldman Sachs Group Inc.", ["Goldman Sachs", "Goldman", "GS"], "GS", "finance"),
    ("Morgan Stanley", ["MS"], "MS", "finance"),
    ("The Vanguard Group", ["Vanguard"], None, "asset_management"),
    ("BlackRock Inc.", ["BlackRock", "BLK"], "BLK", "asset_management"),
    ("State Street Corporation", ["State Street", "STT"], "STT", "asset_management"),
    ("Fidelity Investments", ["Fidelity"], None, "asset_management"),
]
SECTOR_KEYWORDS = {
    "technology": ["tech", "software", "internet", "digital"],
    "finance": ["financial", "banking", "investment"],
    "asset_management": ["investment", "fund", "capital"],
}

# --- mention patterns --------------------------------------------------------
# family -> (type, confidence, [(flags, pattern, parts, ending)]); every match of the
# pattern contains one of the parts (lower-case where the pattern ignores case) and,
# if given, the ending: both are used to skip texts cheaply
MENTION_FAMILIES = {
    "company_formal": ("company", 0.9, [
        ("", r"\b([A-Z][A-Za-z0-9\s\&\-\.]{1,50}(?:\s+(?:Inc|Corp|Corporation|Company|Co|LLC|Ltd|Limited|LP|LLP|plc|PLC|AG|SA|NV|GmbH|KK)\.?))\b",
         [" Inc", " Co", " LLC", " Ltd", " Limited", " LP", " LLP", " plc", " PLC", " AG", " SA", " NV", " GmbH", " KK"],
         r" (?:Inc|Corp|Corporation|Company|Co|LLC|Ltd|Limited|LP|LLP|plc|PLC|AG|SA|NV|GmbH|KK)(?:\.|(?!\w))"),
        ("", r"\b([A-Z][A-Za-z0-9\s\&\-\.]{1,50}(?:\s+(?:Group|Holdings|Partners|Capital|Financial|Services|Industries|Enterprises)(?:\s+(?:Inc|Corp|LLC|Ltd|LP))?))\b",
         [" Group", " Holdings", " Partners", " Capital", " Financial", " Services", " Industries", " Enterprises"], None),
    ]),
    "ticker_symbol": ("ticker", 0.95, [
        ("", r"\$([A-Z]{1,5})\b", ["$"], r"\$[A-Z]"),
        ("i", r"\b(?:NYSE|NASDAQ|LSE|TSE|HKG|TYO):\s*([A-Z]{1,5})\b", ["nyse:", "nasdaq:", "lse:", "tse:", "hkg:", "tyo:"], None),
        ("i", r"\((?:NYSE|NASDAQ|LSE|TSE|HKG|TYO):\s*([A-Z]{1,5})\)", ["(nyse:", "(nasdaq:", "(lse:", "(tse:", "(hkg:", "(tyo:"], None),
        ("", r"\b([A-Z]{2,5})\s+(?:stock|shares?|equity)\b", [" stock", " share", " equity"], None),
    ]),
    "company_informal": ("company_abbrev", 0.8, [
        ("", r"\b(JPM|GS|MS|BAC|WFC|C|USB|PNC|COF|TFC)\b", ["C", "JPM", "GS", "MS", "USB"], r"(?<!\w)(?:JPM|GS|MS|BAC|WFC|C|USB|PNC|COF|TFC)(?!\w)"),
        ("", r"\b(AAPL|MSFT|GOOGL?|AMZN|FB|META|TSLA|NVDA|AMD)\b",
         ["AAPL", "MSFT", "GOOG", "AMZN", "FB", "META", "TSLA", "NVDA", "AMD"], None),
        ("i", r"\b(Big\s+(?:Tech|Four|Five)|FAANG|MAMAA)\b", ["big tech", "big four", "big five", "faang", "mamaa"], None),
    ]),
    "company_international": ("company_intl", 0.85, [
        ("", r"\b([A-Z][A-Za-z0-9\s\-]{1,30}(?:\s+(?:KK|K\.K\.|Co\.,Ltd\.|Corporation)))\b",
         [" KK", " K.K.", " Co.,Ltd.", " Corporation"], None),
        ("", r"\b((?:Kabushiki\s*Kaisha|KK)\s*[A-Za-z0-9\s\-]{1,30})\b", ["Kaisha", "KK"], None),
        ("", r"\b([A-Z][A-Za-z0-9\s\-]{1,30}(?:\s+(?:mbH|SARL|SpA|AB|AS|A\/S|Oy|BV)))\b",
         [" mbH", " SARL", " SpA", " AB", " AS", " A/S", " Oy", " BV"], r" (?:mbH|SARL|SpA|AB|AS|A/S|Oy|BV)(?!\w)"),
    ]),
    "context_indicators": ("company_context", 0.75, [
        ("i", r"(?:CEO|CFO|President|Chairman|founder)\s+(?:of|at)\s+([A-Z][A-Za-z0-9\s\&\-\.]{1,50})",
         [w + " " + p + " " for w in ("ceo", "cfo", "president", "chairman", "founder") for p in ("of", "at")], None),
        ("i", r"([A-Z][A-Za-z0-9\s\&\-\.]{1,50})(?:'s|'s)\s+(?:CEO|CFO|president|earnings|revenue|stock)",
         ["'s ceo", "'s cfo", "'s president", "'s earnings", "'s revenue", "'s stock"], None),
        ("i", r"(?:acquired|bought|merged with|purchased)\s+([A-Z][A-Za-z0-9\s\&\-\.]{1,50})",
         ["acquired ", "bought ", "merged with ", "purchased "], None),
    ]),
}
EXCLUDED_TICKERS = ["I", "O"]
AMBIGUOUS_WORDS = [
    "Apple", "Amazon", "Oracle", "Square", "Box", "Snap", "Match", "Target", "Gap", "Best",
    "First", "Next", "New", "Old", "Big",
]
# (flags, pattern): any one of them in the text keeps an ambiguous word
AMBIGUOUS_CONTEXT = [
    ("i", r"\b(?:Inc|Corp|stock|shares|CEO|company)\b"),
    ("", r"\$[A-Z]{1,5}\b"),
    ("i", r"\b(?:NYSE|NASDAQ):"),
    ("i", r"\b(?:bank|financial|capital|investment|holdings|asset|fund)\b"),
    ("i", r"\b(?:software|technology|tech|cloud|AI|data|cyber|digital)\b"),
    ("i", r"\b(?:retail|store|shopping|consumer|brand)\b"),
    ("i", r"\b(?:pharmaceutical|pharma|medical|healthcare|biotech|drug)\b"),
]
PRONOUN_PATTERNS = [
    ("i", r"\b(?:the\s+company|the\s+firm|it|they|them)\b"),
    ("i", r"\b(?:this|that|these|those)\s+(?:company|firm|business)\b"),
]
TYPE_WEIGHTS = {
    "ticker": 1.0, "company": 0.9, "company_abbrev": 0.8, "company_intl": 0.85,
    "company_context": 0.7,
}
TYPE_WEIGHT_OTHER = 0.5
TYPE_ORDER = {
    "ticker": 5, "company": 4, "company_intl": 3, "company_abbrev": 2, "company_context": 1,
}

# --- mention context ---------------------------------------------------------
CONTEXT_INDUSTRIES = [
    ("finance", r"\b(?:bank|financial|capital|investment|portfolio|fund|trading)\b"),
    ("technology", r"\b(?:software|tech|AI|cloud|data|digital|platform|app)\b"),
    ("healthcare", r"\b(?:pharma|medical|health|drug|biotech|clinical)\b"),
    ("retail", r"\b(?:retail|store|consumer|brand|shopping|commerce)\b"),
    ("energy", r"\b(?:oil|gas|energy|renewable|solar|electric|power)\b"),
    ("manufacturing", r"\b(?:manufacturing|factory|production|industrial)\b"),
]
CONTEXT_FINANCIAL = [
    ("revenue", "i", r"\b(?:revenue|sales|turnover)[\s:]+\$?[\d.,]+[BMK]?\b"),
    ("market_cap", "i", r"\b(?:market\s+cap|valuation)[\s:]+\$?[\d.,]+[BMK]?\b"),
    ("stock_price", "i", r"\$[\d.,]+(?:\s+per\s+share)?"),
    ("percentage", "", r"[\d.,]+%"),
]
CONTEXT_POSITIVE = r"\b(?:growth|profit|success|increase|gain|improve|strong|positive|up)\b"
CONTEXT_NEGATIVE = r"\b(?:loss|decline|decrease|fall|weak|negative|down|risk|concern)\b"

# --- confidence scoring ------------------------------------------------------
FACTOR_WEIGHTS = {
    "patternMatch": 0.25, "domContext": 0.20, "nlpConfidence": 0.25, "crossReference": 0.15,
    "contextConsistency": 0.15,
}
LEVEL_THRESHOLDS = {"high": 0.85, "medium": 0.65, "low": 0.45}
FACTOR_NAMES = {
    "patternMatch": "pattern matching", "domContext": "DOM position",
    "nlpConfidence": "NLP extraction", "crossReference": "entity verification",
    "contextConsistency": "context consistency",
}
POSITION_WEIGHTS = {
    "title": 1.0, "h1": 0.9, "h2": 0.8, "h3": 0.7, "articleHeader": 0.85, "articleBody": 0.6,
    "sidebar": 0.3, "footer": 0.1,
}
POSITION_WEIGHT_OTHER = 0.5
MIN_SCORE_ADAPTER = 0.45
MIN_SCORE_LAYERED = 0.7

# --- layered and list detection ----------------------------------------------
LAYERED_PATTERNS = [
    ("strict", r"\b(BlackRock|Vanguard|State Street|JPMorgan Chase|Goldman Sachs)\b"),
    ("strict", r"\b(Bank of America|Wells Fargo|Citigroup|Morgan Stanley)\b"),
    ("flexible", r"\b\w+\s+(Inc|Corp|LLC|Ltd|Company|Co\.?)\b"),
    ("flexible", r"\b(Chase|BofA|Citi|MS)\b"),
    ("contextual", r"(?:CEO of|founded|headquarters|NYSE:|NASDAQ:)\s*(\w+[\w\s]*)"),
]
LISTED_COMPANIES = [
    "JPMorgan Chase", "Berkshire Hathaway", "Saudi Aramco", "Bank of America",
    "China Construction Bank", "Agricultural Bank of China", "Bank of China", "Goldman Sachs",
    "Morgan Stanley", "Wells Fargo", "BlackRock", "Vanguard", "UnitedHealth Group",
    "Johnson & Johnson", "Procter & Gamble", "Ping An Insurance", "Tencent Holdings",
    "Taiwan Semiconductor", "Samsung Electronics", "ASML Holding", "Tesla", "Meta Platforms",
    "Alphabet", "Microsoft", "Apple", "Amazon", "Nvidia", "Visa", "Mastercard", "Walmart",
    "Exxon Mobil",
]
LISTED_SUFFIXES = [
    "Inc", "Corp", "Corporation", "LLC", "Ltd", "Limited", "Company", "Co", "Group", "plc",
]
LISTED_TYPES = [
    "Bank", "Financial", "Capital", "Holdings", "Insurance", "Investment", "Fund", "Trust",
    "Energy", "Oil",
]
LISTED_COMMON_WORDS = ["The", "This", "That", "With", "From", "About", "Contact"]
CANDIDATE_REJECTS = ["{", "<", "function", "rollbar"]

# key -> [(owner, percent, shares)]
OWNERSHIP_TABLE = {
    "berkshire hathaway": [("Warren Buffett", 16.2, 248734628), ("The Vanguard Group", 9.8, 150423891),
                           ("BlackRock Inc", 8.1, 124567234)],
    "jpmorgan": [("The Vanguard Group", 7.8, 235678901), ("BlackRock Inc", 6.2, 187345123),
                 ("State Street Corp", 4.9, 148234567)],
    "bank of america": [("Berkshire Hathaway", 13.1, 1032852006), ("The Vanguard Group", 7.4, 583456789),
                        ("BlackRock Inc", 6.8, 536789012)],
    "tesla": [("Elon Musk", 20.5, 411062076), ("The Vanguard Group", 7.1, 142456789),
              ("BlackRock Inc", 5.8, 116234567)],
    "apple": [("The Vanguard Group", 7.3, 1156234567), ("BlackRock Inc", 6.1, 965789012),
              ("Berkshire Hathaway", 5.8, 915560382)],
    "default": [("Institutional Investors", 65.3, None), ("Individual Investors", 34.7, None)],
}

# --- sites -------------------------------------------------------------------
SITE_HOSTS = {
    "www.forbes.com": "forbes", "finance.yahoo.com": "yahoo", "www.bloomberg.com": "bloomberg",
    "www.marketwatch.com": "marketwatch",
}
TRUSTED_ORIGINS = [
    ("forbes", r"^https:\/\/(www\.)?forbes\.com"),
    ("yahoo", r"^https:\/\/finance\.yahoo\.com"),
    ("bloomberg", r"^https:\/\/(www\.)?bloomberg\.com"),
    ("marketwatch", r"^https:\/\/(www\.)?marketwatch\.com"),
]
COMPANY_PAGE_PATHS = [
    r"\/companies\/[^\/]+\/?$", r"\/company\/[^\/]+\/?$", r"\/lists\/.*\/companies\/[^\/]+",
    r"\/profile\/[^\/]+\/?$", r"global2000.*companies",
]
COMPANY_PAGE_PARTS = ["/companies/", "/company/", "/profile/"]
COMPANY_SLUGS = [
    r"\/companies\/([^\/\?]+)", r"\/company\/([^\/\?]+)", r"\/profile\/([^\/\?]+)",
    r"\/lists\/[^\/]*\/companies\/([^\/\?]+)",
]
COMPANY_TITLES = [
    ("", r"^([^|]+)\s*\|"), ("", r"^([^-]+)\s*-"), ("i", r"^(.+?)\s*Stock Price"),
    ("i", r"^(.+?)\s*Company Overview"),
]
EXCHANGE_NAMES = {
    "US": "NYSE/NASDAQ", "LN": "LSE", "HK": "HKEX", "JP": "TSE", "GR": "XETRA", "FP": "EPA",
}
SITE_PATTERNS = {
    "forbes": [("companyLink", r"\/companies\/([^\/]+)\/?$"), ("profileLink", r"\/profile\/([^\/]+)\/?$"),
               ("tickerPattern", r"\(([A-Z]{1,5})\)")],
    "yahoo": [("symbolPattern", r'data-symbol="([A-Z]{1,5})"'), ("tickerInUrl", r"quote\/([A-Z]{1,5})"),
              ("companyInTitle", r"^(.+?)\s*\([A-Z]{1,5}\)")],
    "bloomberg": [("tickerFormat", r"([A-Z]{1,5})(?:\s+(?:US|LN|HK|JP))?(?:\s+Equity)?"),
                  ("companyMention", r"\b([A-Z][a-zA-Z\s\&\.]{2,50})\s+(?:said|announced|reported)")],
    "marketwatch": [("tickerInLink", r"\/investing\/stock\/([A-Z]{1,5})"),
                    ("companyFormat", r"([A-Z][a-zA-Z\s\&\.]{2,50})(?:\s+\([A-Z]{1,5}\))?")],
}
SITE_MULTIPLIERS = {
    "forbes": {"inHeadline": 1.5, "inFirstParagraph": 1.3, "hasCompanyLink": 1.4, "inQuote": 0.8},
    "yahoo": {"hasDataSymbol": 2.0, "inQuoteHeader": 1.8, "inNewsHeadline": 1.4, "inFinancialTable": 1.2},
    "bloomberg": {"hasTicker": 1.6, "inHeadline": 1.5, "hasCompanyTag": 1.4, "inLead": 1.3},
    "marketwatch": {"hasStockLink": 1.5, "inHeadline": 1.4, "inFirstParagraph": 1.3, "hasTickerTag": 1.4},
}

# A selector is (tag, class, attribute, attribute part); None = any. A list of
# selectors in a row means "inside": [outer, inner].
SITE_STRUCTURE = {
    "forbes": {
        "articleContainer": [("article", None, None, None), (None, "article-text", None, None),
                             (None, None, "role", "article")],
        "headline": [("h1", None, None, None), (None, "article-headline", None, None),
                     (None, "fs-headline", None, None)],
        "subheadline": [("h2", None, None, None), (None, "article-subhead", None, None)],
        "body": [(None, "article-body", None, None), (None, "article-text", None, None),
                 (None, "body-content", None, None)],
        "companyMentions": [("a", None, "href", "/companies/"), (None, "company-tag", None, None)],
        "metadata": [(None, "article-meta", None, None), (None, "byline", None, None),
                     ("time", None, None, None)],
    },
    "yahoo": {
        "quoteHeader": [(None, None, "data-symbol", ""), (None, "quote-header-section", None, None)],
        "companyName": [("h1", None, "data-symbol", ""), (None, "company-name", None, None)],
        "ticker": [(None, None, "data-symbol", ""), (None, "ticker-symbol", None, None)],
        "newsItem": [(None, "news-item", None, None), ("article", "js-stream-content", None, None)],
        "priceInfo": [(None, None, "data-field", "regularMarketPrice")],
        "metadata": [(None, "published-date", None, None), (None, "author-info", None, None)],
    },
    "bloomberg": {
        "articleContainer": [("article", None, None, None), (None, "article-wrap", None, None)],
        "headline": [("h1", "headline", None, None), (None, "headline__text", None, None)],
        "ticker": [(None, "ticker", None, None), (None, "stock-ticker", None, None)],
        "companyTag": [(None, "company-tag", None, None), (None, None, "data-type", "company")],
        "body": [(None, "body-content", None, None), (None, "article-body__content", None, None)],
        "metadata": [(None, "published-date", None, None), (None, "byline", None, None)],
    },
    "marketwatch": {
        "articleContainer": [(None, "article__content", None, None), ("article", None, None, None)],
        "headline": [("h1", "article__headline", None, None)],
        "ticker": [(None, "ticker", None, None), (None, "company-ticker", None, None)],
        "companyLink": [("a", None, "href", "/investing/stock/")],
        "body": [(None, "article__body", None, None), (None, "paywall", None, None)],
        "metadata": [(None, "article__timestamp", None, None), (None, "author", None, None)],
    },
}
BASE_CANDIDATES = [
    [("h1", None, None, None)], [("h2", None, None, None)], [("h3", None, None, None)],
    [("p", None, None, None)], [("span", None, None, None)], [("a", None, None, None)],
    [(None, None, "data-symbol", "")], [(None, None, "data-ticker", "")],
    [(None, "company-name", None, None)],
]
SITE_CANDIDATES = {
    "forbes": [
        [("h1", "listuser-header__name", None, None)], [("h3", "listuser-block__title", None, None)],
        [(None, "company-name", None, None)], [(None, "organization-title", None, None)],
        [(None, None, "data-ga-track", "company")], [(None, "profile-name", None, None)],
        [(None, "Forbes2000-profile-name", None, None)], [(None, "company-ticker", None, None)],
        [(None, "ticker-symbol", None, None)], [(None, None, "data-ticker", "")],
        [(None, "profile-stats", None, None)], [(None, "company-info", None, None)],
        [(None, "article-body", None, None)],
    ] + BASE_CANDIDATES,
    "yahoo": [
        [(None, None, "data-symbol", "")], [(None, "company-name", None, None)],
        [("h1", None, "data-symbol", "")],
        [(None, "quote-header-section", None, None), ("h1", None, None, None)],
        [(None, "ticker-symbol", None, None)],
        [(None, "news-item", None, None), ("h3", None, None, None)],
        [(None, "js-stream-content", None, None), ("h3", None, None, None)],
        [("a", None, "href", "/quote/")], [(None, "market-summary-item", None, None)],
        [(None, "trending-ticker", None, None)], [(None, "quote-link", None, None)],
        [(None, None, "data-test", "quote-links")],
        [(None, "asset-profile", None, None), ("h3", None, None, None)],
        [(None, "recommendation-list-item", None, None)],
    ],
    "bloomberg": [
        [(None, "headline__text", None, None)], [(None, "article-headline", None, None)],
        [(None, "ticker", None, None)], [(None, "stock-ticker", None, None)],
        [(None, "company-tag", None, None)], [(None, None, "data-type", "company")],
        [(None, "body-content", None, None), ("p", None, None, None)],
        [(None, "article-body__content", None, None), ("p", None, None, None)],
        [(None, "quote-data", None, None)], [(None, "market-summary", None, None)],
        [("a", None, "href", "/quote/")], [(None, "related-ticker", None, None)],
        [(None, "terminal-ticker", None, None)], [(None, "bbg-ticker", None, None)],
        [(None, None, "class", "ticker-")], [(None, "market-data-row", None, None)],
        [(None, "securities-table", None, None), ("td", None, None, None)],
    ],
    "marketwatch": [
        [(None, "article__headline", None, None)], [(None, "ticker", None, None)],
        [(None, "company-ticker", None, None)], [("a", None, "href", "/investing/stock/")],
        [(None, "article__body", None, None), ("p", None, None, None)],
        [(None, "paywall", None, None), ("p", None, None, None)], [("bg-quote", None, None, None)],
        [(None, "markets__ticker", None, None)], [(None, "quote__ticker", None, None)],
        [(None, "trending-tickers", None, None), ("a", None, None, None)],
        [(None, "watchlist__symbol", None, None)], [(None, "headline--link", None, None)],
        [(None, "latestNews__headline", None, None)], [(None, "element--intraday", None, None)],
        [(None, "markets-data", None, None), ("td", None, None, None)],
        [(None, "screener__cell", None, None)], [(None, None, "data-ticker", "")],
        [(None, "movers__item", None, None)], [(None, "futures__symbol", None, None)],
    ],
}
CHROME = {
    "bloomberg": [(None, "ad-container", None, None), (None, "promotion", None, None),
                  (None, None, "data-ad-placeholder", ""), ("nav", None, None, None),
                  (None, "navigation", None, None), (None, "menu", None, None)],
    "marketwatch": [(None, "navigation", None, None), (None, "header", None, None),
                    (None, "footer", None, None), (None, "ad-container", None, None)],
}
ELIGIBLE_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "a", "span", "strong", "b", "em"]
SKIPPED_TAGS = ["script", "style", "noscript", "iframe", "object", "embed"]
ELIGIBLE_CLASS = r"company|name|title|brand|corp|inc|ltd"
ELIGIBLE_TEXT = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]*)*(?:\s+(?:Inc|Corp|LLC|Ltd)\.?)?\b"

# --- registry, contracts, macro, news ----------------------------------------
OFFSHORE_CODES = [
    "ky", "bm", "vg", "je", "gg", "im", "ch", "lu", "ie", "nl", "sg", "hk", "pa", "bs", "bb",
]
SECRECY_CODES = ["ky", "bm", "vg"]
ALLOWED_JURISDICTIONS = [
    "us", "gb", "ch", "ky", "bm", "ie", "lu", "nl", "sg", "hk", "ca", "au", "de", "fr", "it",
    "es", "jp", "kr",
]
AGENCY_WEIGHTS = {
    "DEPARTMENT OF DEFENSE": 1.2, "DEPARTMENT OF HEALTH AND HUMAN SERVICES": 0.8,
    "DEPARTMENT OF VETERANS AFFAIRS": 0.9, "DEPARTMENT OF ENERGY": 1.1,
    "NATIONAL AERONAUTICS AND SPACE ADMINISTRATION": 1.0,
    "DEPARTMENT OF HOMELAND SECURITY": 1.3,
}
CLASSIFIED_KEYWORDS = [
    "classified", "secret", "confidential", "security clearance", "top secret", "restricted",
    "sensitive", "defense", "military", "intelligence", "surveillance",
]
AWARD_TYPES = ["A", "B", "C", "D"]
SECTOR_SERIES = {
    "Financial": ["FEDFUNDS", "TB3MS", "AAA", "MORTGAGE30US"],
    "Technology": ["NASDAQCOM", "PAYEMS", "CPILFESL", "GDPC1"],
    "Healthcare": ["HLTHSCPCHCSA", "GDPC1", "PAYEMS", "CPILFESL"],
    "Energy": ["DCOILWTICO", "DHHNGSP", "GDPC1", "CPILFESL"],
    "Default": ["GDPC1", "UNRATE", "CPILFESL", "FEDFUNDS"],
}
# (list, sector or None, series, trend, sentence) in the order the sentences are added
MACRO_RULES = [
    ("opportunities", None, "GDPC1", "RISING", "GDP growth may drive institutional investment"),
    ("risks", None, "GDPC1", "FALLING", "GDP decline may trigger portfolio rebalancing"),
    ("implications", None, "RATES", "RISING", "Rising rates may shift institutional preferences"),
    ("opportunities", "Financial", "RATES", "RISING", "Rising rates typically benefit financial sector"),
    ("implications", None, "RATES", "FALLING", "Lower rates may increase growth stock appetite"),
    ("opportunities", "Financial", "FEDFUNDS", "RISING", "Rising Fed rates improve net interest margins"),
    ("risks", "Financial", "MORTGAGE30US", "RISING", "Rising mortgage rates may slow lending volume"),
    ("risks", "Technology", "NASDAQCOM", "FALLING", "Tech market decline may trigger institutional selling"),
    ("opportunities", "Technology", "PAYEMS", "RISING", "Strong employment supports tech demand"),
    ("opportunities", "Energy", "DCOILWTICO", "RISING", "Rising oil prices benefit energy sector margins"),
    ("opportunities", "Healthcare", "HLTHSCPCHCSA", "RISING", "Healthcare inflation may drive sector investment"),
]
OWNERSHIP_KEYWORDS = [
    "stake", "shares", "investment", "acquisition", "merger", "holdings", "portfolio",
    "institutional", "hedge fund", "activist investor", "buyout", "takeover", "proxy fight",
    "shareholder", "board", "dividend", "spin-off",
]
TIER1_SOURCES = [
    "reuters", "bloomberg", "wsj", "ft", "cnbc", "marketwatch", "seeking-alpha", "barrons",
]
OWNERSHIP_PATTERNS = [
    r"(\d+)%?\s*(stake|shares|holding)",
    r"(increased|decreased|acquired|sold)\s*\d+",
    r"(institutional|hedge fund|activist)\s*(investor|investment)",
    r"(board|proxy|takeover|merger)",
]
HEADLINE_POSITIVE = [
    "growth", "increase", "profit", "gain", "success", "strong", "beat", "exceed", "upgrade",
    "buy", "bullish", "optimistic",
]
HEADLINE_NEGATIVE = [
    "decline", "loss", "fall", "weak", "miss", "downgrade", "sell", "bearish", "concern", "risk",
    "problem", "challenge",
]
INVESTOR_TYPES = ["hedge fund", "pension fund", "mutual fund", "etf", "institutional"]

# --- integrity ---------------------------------------------------------------
OWNER_NAME_PATTERN = r"^[A-Za-z0-9\s\.\,\&\-\(\)]{2,100}$"
OWNER_PERCENT_PATTERN = r"^\d{1,3}(\.\d{1,2})?%?$"
MAX_OWNERS = 50
MAX_OWNERSHIP_TOTAL = 105
JURISDICTION_PATTERN = r"^[a-z]{2,3}$"
AWARD_ID_PATTERN = r"^[A-Z0-9\-_]{8,25}$"
MAX_AWARD_AMOUNT = 1000000000000
INJECTION_PATTERNS = [
    r"<script", r"javascript:", r"onclick=", r"onerror=", r"onload=", r"<iframe", r"eval\(",
    r"document\.", r"window\.", r"\.\.\/", r"union\s+select", r"drop\s+table",
]
FAKE_NAME_PARTS = ["test", "fake", "sample"]
FAKE_NAMES = ["John Doe", "Jane Doe"]
ANOMALY_WARN = 0.8
ANOMALY_QUARANTINE = 0.95

# --- request limits ----------------------------------------------------------
# action -> (requests, window seconds, penalty seconds), in checking order
REQUEST_LIMITS = [
    ("BURST_LIMIT", 10, 1, 10), ("GLOBAL_LIMIT", 50, 60, 60), ("HOURLY_LIMIT", 200, 3600, 300),
    ("DAILY_LIMIT", 1000, 86400, 3600),
]
PATTERN_LIMITS = {"burst": (8, 1), "rapid": (15, 5), "hourly": (100, 3600)}
TIMING_MIN_REQUESTS = 10
TIMING_MAX_CV = 0.1
TIMING_HISTORY = 86400
# source -> (failures that open the circuit, recovery seconds)
SOURCE_TIERS = {
    "yahoo": (5, 60), "sec": (5, 60), "opencorporates": (3, 30), "usaspending": (3, 30),
    "fred": (3, 30), "news": (2, 15), "worldbank": (2, 15),
}
