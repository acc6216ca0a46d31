"""Word lists, look-up tables, weights and limits of the news ranking.

Results depend on every one of them, so they are stated as plain values in
natural order. Regular expressions are put together from the lists by
``any_word`` and are written in the syntax that Java and RE2 share.
"""

from __future__ import annotations


def one_of(entries: list[str]) -> str:
    """Any of the entries, as a group."""
    return "(?:" + "|".join(entries) + ")"


def any_word(*entries: str) -> str:
    """Any of the entries as whole words."""
    return r"\b" + one_of(list(entries)) + r"\b"


# ---- fixed values: feeds, (label, url, bucket, window in hours) ----
FEEDS = [
    ("CoinDesk", "https://www.coindesk.com/arc/outboundfeeds/rss/", "crypto", None),
    ("The Block", "https://www.theblock.co/rss.xml", "crypto", None),
    ("Decrypt", "https://decrypt.co/feed", "crypto", None),
    ("The Defiant", "https://thedefiant.io/api/feed", "crypto", None),
    ("DL News", "https://dlnews.com/arc/outboundfeeds/rss/", "crypto", None),
    ("Unchained", "https://unchainedcrypto.com/feed/", "crypto", None),
    ("CNBC", "https://www.cnbc.com/id/100003114/device/rss/rss.html", "macro", None),
    ("FT Markets", "https://www.ft.com/markets?format=rss", "macro", None),
    ("Bloomberg", "https://feeds.bloomberg.com/markets/news.rss", "macro", None),
    ("SCMP Business", "https://www.scmp.com/rss/2/feed", "macro", None),
    ("Channel News Asia", "https://www.channelnewsasia.com/rssfeeds/8395986", "macro", None),
    ("ECB Press", "https://www.ecb.europa.eu/rss/press.html", "macro", 72),
]
BUCKETS = ("crypto", "macro")
SYMBOLS = {"BTCUSDT": "BTC", "ETHUSDT": "ETH", "SOLUSDT": "SOL", "XRPUSDT": "XRP"}

# ---- fixed values: limits ----
WINDOW_HOURS = 24
MAX_PER_SOURCE = 40
LIMITS = {"crypto": (6, 12), "macro": (3, 6)}
SCORE_THRESHOLD = 0.30
DEDUPE_THRESHOLD = 0.50
MAX_PER_SUBJECT = 3
ALERT_THRESHOLD = 0.72
ALERT_TTL_HOURS = 48
ALERT_POLL_MINUTES = 15
DIGEST_TIME, DIGEST_TZ = "08:30", "Asia/Hong_Kong"
CACHE_TTL_MINUTES = 20
DIGEST_BULLETS = 10
FALLBACK_BULLETS = 6
MESSAGE_LIMIT = 4096
MAX_FEATURES = 1000
SUMMARY_CHARS, PROMPT_SUMMARY_CHARS = 400, 320

# ---- fixed values: factors in order, and how depth splits the style budget ----
FACTOR_WEIGHTS = {
    "keyword": 0.185, "recency": 0.185, "source_quality": 0.185, "topicality": 0.130,
    "source_count": 0.075, "numeric": 0.100, "analysis": 0.100, "asset": 0.040,
}
DEPTH_SPLITS = {"data": (0.170, 0.030), "balanced": (0.100, 0.100), "analysis": (0.030, 0.170)}

DEPTH_LABELS = {"data": "Numbers", "balanced": "Balanced", "analysis": "Analysis"}
DEPTH_BLURBS = {"data": "stories with hard figures move up", "balanced": "figures and commentary count alike", "analysis": "commentary and outlooks move up"}

# ---- fixed values: keyword stems by tier, their endings and scores ----
KEYWORD_TIERS = {
    1: ["fed", "fomc", "cpi", "hack", "exploit", "bankrupt", "insolvency"],
    2: ["rate", "inflation", "etf", "sec", "war", "sanction", "tariff", "lawsuit", "fraud", "depeg", "liquidation", "halt", "default"],
    3: [
        "tvl", "stablecoin", "restaking", "blackrock", "fidelity", "grayscale", "microstrategy", "ofac", "mica", "treasury", "yield",
        "custody", "rwa", "tokenization", "upgrade", "fork", "unlock",
    ],
    4: ["btc", "bitcoin", "eth", "ethereum", "sol", "solana", "defi", "halving", "merge", "airdrop", "nft", "layer2"],
}
STEM_ENDINGS = ["s", "es", "ed", "d", "ing", "er", "ers", "cy"]
TIER_SCORES = {1: 1.0, 2: 0.75, 3: 0.5, 4: 0.25}

# ---- fixed values: outlets ----
SOURCE_QUALITY = {
    "FT Markets": 1.00, "Bloomberg": 1.00, "ECB Press": 1.00, "The Block": 1.00,
    "DL News": 0.95, "Unchained": 0.95, "CNBC": 0.90,
    "CoinDesk": 0.85, "The Defiant": 0.85, "SCMP Business": 0.85,
    "Decrypt": 0.75, "Channel News Asia": 0.75,
}
DEFAULT_QUALITY = 0.60

# ---- fixed values: tags ----
RELEVANT_TAGS = [
    "bitcoin", "ethereum", "crypto", "cryptocurrency", "defi", "blockchain", "stablecoin", "regulation", "sec", "etf", "markets",
    "economy", "fed", "central-banks", "monetary-policy", "inflation", "trade", "geopolitics", "policy", "business", "finance",
]
OFFTOPIC_TAGS = ["sports", "entertainment", "lifestyle", "travel", "food", "arts"]

# ---- fixed values: figures, style and assets ----
UNITS = ["bn", "billion", "m", "million", "k", "thousand", "trillion"]
LARGE_UNITS = ["bn", "billion", "million", "trillion"]
FIGURE = (
    r"\$[\d,.]+(?:\s*(?:" + "|".join(UNITS) + r"))?"
    r"|[\d,.]+\s*%"
    r"|\b\d{1,3}(?:,\d{3})+\b"
    r"|\b[\d,.]+\s*(?:" + "|".join(LARGE_UNITS) + r")\b"
)
FRAMING = any_word(*[
    "why", "what", "how", "explainer", "analysis", "opinion", "outlook", "forecast", "takeaways?", r"deep\s?dive",
    r"breaking\s?down", "inside", "behind", "could", "would", "should", "whether", "if", "signals?", "suggests?", "means",
    "case for", "risk of", "set to", "poised",
])
ATTRIBUTION = any_word(*[
    "analysts?", "strategists?", "economists?", "researchers?", "says?", "said", "argues?", "warns?", "warned", "expects?",
    "predicts?", "sees", "flags?", "points? to", "weighs?",
])
COLON_SOURCE = r":\s*[A-Z][\w.&' -]{2,30}\s*$"
LONG_SUMMARY = 220
ASSETS = [
    (1.0, any_word("btc", "bitcoin", "eth", "ethereum"), "major asset (BTC/ETH)"),
    (0.7, any_word("sol", "solana", "xrp", "ripple", "bnb", "sui", "hyperliquid"), "large alt"),
    (0.3, any_word("doge", "shib", "pepe", "altcoin", "memecoin"), "memecoin / long tail"),
]
SUBJECTS = [
    ("bitcoin", any_word("btc", "bitcoin")),
    ("ethereum", any_word("eth", "ethereum", "ether")),
    ("solana", any_word("sol", "solana")),
    ("xrp", any_word("xrp", "ripple")),
]

# ---- fixed values: what is rejected ----
CLICKBAIT = [
    r"\btop\s*\d+\b",
    r"\b\d+\s+(?:things|ways|reasons|coins?|tokens?)\b",
    r"\bwatch(?:list|\s+list)\b",
    any_word("celebrity", "celeb", "obituary", "wedding", "horoscope"),
    any_word("lifestyle", "fashion", "recipe"),
    r"\bbest\s+of\b",
    r"\bprice\s+(?:prediction|forecast|target)\b",
    r"\b(?:could|will|might)\s+(?:hit|reach|explode|moon)\b",
    r"^\d+\s+altcoins?\s+to\b",
    r"\bhere'?s\s+(?:why|what|how)\b.*\bnext\b",
]
TICK_VERBS = [
    "break", "breaks", "broke", "rose", "rises", "fell", "falls", "slips?", "slid", "surged?", "climbed?", "jumped?", "dropped?",
    "plunged?", "tumbled?",
]
TICK_WHERE = ["above", "below", "through", "past", "to"]
TICK_LEAD = r"\b" + one_of(TICK_VERBS) + r"\s+" + one_of(TICK_WHERE) + r"\s+"
TICK_PRICE = (
    r"(?:\$[\d,.]+|[\d,.]+\s*(?:USDT|USD)\b|[\d,.]+\b)(?![\d,.])"
    r"(?!\s*(?:billion|million|trillion|years?)\b)(?![MBK]\b)(?!-day\b)"
)
TICK_OTHERS = [
    r"\bcurrently trading at\b",
    r"\b(?:up|down)\s+[\d.]+%\s+(?:on the day|intraday|in 24 hours)\b",
    r"\b(?:rose|fell|gained|lost|surged|dropped)\s+[\d.]+%\s+(?:to|intraday)\b",
]
CONTINUATION = any_word(*[
    "as", "after", "amid", "while", "despite", "because", "following", "warns?", "says?", "said", "analysts?", "setting",
    "hits? record", "all-time high", "ath", "if", "could", "what", "since",
])
MACRO_RELEVANT = [
    any_word(*["fed", "fomc", "central bank", "rate", "rates", "inflation", "cpi", "ppi", "pce"]),
    any_word(*["treasur(?:y|ies)", "yield", "bond", "dxy", "dollar", "fx", "liquidity"]),
    any_word(*["gdp", "pmi", "jobs?", "payrolls?", "unemployment", "retail sales"]),
    any_word(*["oil", "wti", "brent", "energy", "gas", "shipping", "hormuz"]),
    any_word(*["tariff", "sanction", "geopolitical", "war", "ceasefire"]),
    any_word(*["sec", "crypto", "bitcoin", "stablecoin", "token", "exchange"]),
    any_word(*["global markets?", "risk assets?", "stocks?", "nasdaq", "s&p", "volatility", "vix"]),
]
MACRO_OFFTOPIC = [
    any_word(*["beauty", "fashion", "style", "lifestyle", "recipe", "travel", "dining"]),
    any_word(*["world cup", "olympics?", "ticket prices?", "fans?", "pope"]),
    any_word(*["celebrity", "entertainment", "box office", "streaming series"]),
    any_word(*["murder", "trial", "court case"]),
    any_word(*["gop", "democrat", "republican", "midterm", "campaign cash", "polls?"]),
    any_word(*["earnings beat", "shares jump", "analyst upgrade"]),
]
MIN_TITLE = 8
REJECT_REASONS = {
    "no_title": "empty or malformed title",
    "clickbait": "listicle / price-prediction pattern",
    "price_tick": "bare price move, already in the market panel",
    "macro_offtopic": "general news with no market or policy relevance",
}

# ---- fixed values: categories in priority order ----
CATEGORY_WORDS = {
    "security": [
        "hack", "hacks", "hacked", "hacker", "hackers", "hacking", "exploit", "exploits", "exploited", "breach", "breached", "drain",
        "drained", "stolen", "theft", "scam", r"rug\s?pull", "depeg", "depegged", r"insolven\w+", r"bankrupt\w*", r"liquidat\w+",
        "attack", "attacked", r"vulnerab\w+", "halts?", "halted", "freeze", "frozen",
    ],
    "regulation": [
        "sec", "cftc", r"regulat\w+", "lawsuit", "litigation", "sue", "sued", "sues", "suing", "court", "judge", "ruling", "settlement",
        "subpoena", "enforcement", r"legislat\w+", "bill", "congress", "senate", "ban", "banned", "licence", "license", "licensing",
        "compliance", "mica", "ofac", "probe", r"investigat\w+", "clarity act", r"(?:digital[- ]asset|crypto|capital[- ]gains)\s+tax",
        r"tax\s+(?:rule|law|bill|code|treatment|guidance|policy)", "taxation",
    ],
    "flows": [
        "etf", "etfs", r"inflow\w*", r"outflow\w*", "custody", "custodian", "blackrock", "fidelity", "grayscale", "vanguard",
        "microstrategy", r"(?:crypto|bitcoin|digital[- ]asset|token(?:ized)?|rlusd|stablecoin)\s+(?:\w+\s+)?fund\w*",
        r"corporate treasur\w+", "treasury (?:holdings?|company|reserves?)", r"institution\w*", r"allocat\w+\s+(?:to|into)",
        r"portfolio allocat\w+", "aum", "holdings?", r"accumulat\w+", r"whale\w*",
    ],
    "macro": [
        "fed", "fomc", "federal reserve", "ecb", "boj", r"central bank\w*", "cpi", "ppi", "pce", r"treasur\w+", "inflation", "deflation",
        "rate", "rates", r"yield\w*", r"bond\w*", "dxy", "dollar", "currency", "gdp", r"payroll\w*", "unemployment", "recession",
        "stimulus", "qe", "liquidity", "jobs report", r"econom\w+", "fiscal", r"deficit\w*", "budget", "state spending", "war",
        "conflict", "ceasefire", "embargo", "output", "supply chain", r"sanction\w*", r"tariff\w*", "trade (?:talks?|war|deal)", "s&p",
        "nasdaq", "dow", r"equit\w+", "stocks?", "vix", "volatility", r"hedge fund\w*", r"money[- ]market fund\w*", "money[- ]market",
        "commercial paper", "oil", "wti", "brent", "energy sector",
    ],
    "protocol": [
        r"upgrade\w*", r"fork\w*", "mainnet", "testnet", r"layer\s?2", "l2", r"rollup\w*", "staking", r"stake\w*", r"validator\w*",
        r"airdrop\w*", r"unlock\w*", "tvl", r"protocol\w*", "defi", "dex", r"bridge\w*", r"token\w*", r"smart contract\w*", "consensus",
        "throughput", r"node\w*",
    ],
}
CATEGORIES = list(CATEGORY_WORDS)
CATEGORY_LABELS = {
    "security": "Security & risk", "regulation": "Regulation & policy", "flows": "Institutional flows",
    "macro": "Macro & rates", "protocol": "Protocol & tech",
}
CATEGORY_BLURBS = {
    "security": "hacks, exploits, depegs, insolvency, liquidations",
    "regulation": "SEC, lawsuits, legislation, licensing, enforcement",
    "flows": "ETFs, treasuries, custody, corporate holdings",
    "macro": "Fed, CPI, central banks, yields, broad markets",
    "protocol": "upgrades, forks, L2s, DeFi mechanics, airdrops",
}
CATEGORY_EMOJI = {"security": "🔓", "regulation": "⚖️", "flows": "🏦", "macro": "📉", "protocol": "⚙️"}

# ---- fixed values: folding of words before comparison ----
TICKERS = {
    "btc": "bitcoin", "eth": "ethereum", "sol": "solana", "xrp": "ripple", "doge": "dogecoin",
    "ada": "cardano", "avax": "avalanche", "dot": "polkadot", "link": "chainlink", "bnb": "binancecoin",
}
VERBS = {
    "rally": [
        "tops", "breaks", "hits", "rallies", "surges", "climbs", "jumps", "pumps", "soars", "spikes", "rises", "gains", "topped",
        "broke", "hit", "rallied", "surged", "climbed", "jumped", "pumped", "soared", "spiked", "rose", "gained",
    ],
    "fall": [
        "drops", "falls", "slides", "crashes", "plunges", "tumbles", "dumps", "sinks", "slumps", "dives", "dropped", "fell", "slid",
        "crashed", "plunged", "tumbled", "dumped", "sank", "slumped", "dived", "dove",
    ],
}
STOPWORDS = [
    "on", "in", "at", "amid", "for", "the", "a", "an", "of", "and", "or", "to", "by", "with", "from", "as", "is", "are", "was",
    "were", "be", "been", "has", "have", "had", "will", "would", "can", "could", "may", "might", "near", "this", "that", "these",
    "those", "it", "its", "new", "says", "said", "reports", "report", "after", "before", "over", "under",
]
PROPER_NOUN = r"\b([A-Z][a-zA-Z]+|[A-Z]{2,})\b"
ENTITY_IGNORE = [
    "the", "a", "an", "this", "that", "new", "here", "how", "why", "what", "after", "before", "amid", "as", "while", "data",
    "analysis", "report", "us", "usd", "usdt", "wall", "street", "south", "north", "korean", "korea", "japanese", "japan", "index",
    "live", "breaking", "update", "etf", "etfs", "nft", "nfts", "dao", "daos", "ipo", "ipos", "ceo", "cfo", "cto", "api", "apis",
    "ai", "tvl", "defi", "gdp", "cpi", "ppi", "pce", "q1", "q2", "q3", "q4",
]
GENERIC_ENTITIES = ["bitcoin", "ethereum"]
RARE_MAX, RARE_SHARE = 4, 0.10

# ---- fixed values: bands of the printed score ----
STRONG_AT, NOTABLE_AT = 0.65, 0.45
