"""Fixed values.

Results depend on these being exactly as written: word lists, patterns
and formats. Patterns are Java regular expressions unless noted.
"""

# --- fixed values: prices and stock -----------------------------------------
PRICE_NUMBER = r"\d+\.?\d*"
OUT_OF_STOCK_TOKENS = ["outofstock", "soldout", "discontinued"]
DEFAULT_CURRENCY = "USD"

# --- fixed values: first-party feed -----------------------------------------
FEED_SOURCE = "internal_feed"
CRAWL_SOURCE = "scheduled_crawl"
FEED_COLUMNS = ["sku", "brand_num", "category", "name", "grade", "season", "price"]
SEASON_CODE = r"^([FSfs])(\d{2})$"

# --- fixed values: product search -------------------------------------------
SEARCH_STOPWORDS = [
    "the", "and", "of", "for", "with", "our", "your", "in", "on", "is", "are",
]
MIN_KEYWORD_LENGTH = 3
RANK_TERM_WEIGHT = 0.1
RANK_NORMALISER = 1.64493406685
DEFAULT_COMPARABLE_LIMIT = 5
DEFAULT_SEARCH_LIMIT = 20

# --- fixed values: dashboard and retrieval limits ---------------------------
DEFAULT_TREND_DAYS = 90
DEFAULT_PAGE_SIZE = 50
CAMPAIGN_SEARCH_LIMIT = 20
ACTIVITY_LIMIT = 12
STATUS_LABELS = {
    "success": "Crawled cleanly",
    "partial_failure": "Crawled with some errors",
    "failed": "Crawl failed",
    "running": "Crawl in progress",
}

# --- fixed values: URLs ------------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref",
    "referrer", "_ga", "_gl", "yclid",
]
PRODUCT_PATH = r"(?i)/(products?|item|p)/"
CATEGORY_PATH = r"(?i)/(collections?|categor(y|ies)|shop|catalog)/"
PROMO_PATH = r"(?iU)/(sale|clearance|deals?|promo(tions?)?|coupons?|specials?)\b"
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"

# --- fixed values: pagination ------------------------------------------------
PRICE_CONTEXT_CHARS = 40
RECYCLED_SIMILARITY = 0.5
CONTEXT_PIECE_CHARS = 8
CONTEXT_WINDOW_PIECES = 4
# Rolling hash of a piece: digits to this base, modulo a prime below 2^31.
PIECE_BASE = 1_000_003
PIECE_PRIME = 2_147_483_647

# --- fixed values: page markup -----------------------------------------------
MIN_USABLE_TEXT = 200
JS_REQUIRED_PHRASES = [
    "enable javascript", "requires javascript", "please turn on javascript",
]
PRODUCT_ITEMTYPE = r"(?iU)schema\.org/Product\b"
EMBEDDED_PRODUCT_ID_PREFIX = "productjson"
CARD_TAGS = ["li", "div", "article"]
CARD_CLASS = r"(?i)product"
CARD_HEADING_TAGS = ["h1", "h2", "h3", "h4"]
CARD_PRICE_TAGS = ["span", "div", "p"]
CARD_PRICE_CLASS = r"(?i)price"

# --- fixed values: promotions ------------------------------------------------
BANNER_TAGS = ["div", "section", "aside", "p", "a"]
BANNER_HINT = r"(?i)announce|banner|promo|hero|marquee|top-?bar"
DISCOUNT_SIGNAL = (
    r"(?iU)%\s?off|\$\d+(?:\.\d{2})?\s?off|buy one get one|\bbogo\b|free shipping|"
    r"clearance|\bsale\b|coupon|promo code|use code"
)
PERCENT_OFF = r"(?iU)\b(\d{1,3})\s?%\s?off\b"
DOLLAR_OFF = r"(?iU)\$(\d+(?:\.\d{2})?)\s?off\b"
COUPON_CODE = r"(?U)(?:code|coupon)[:\s]+([A-Z0-9]{3,20})\b"
MAX_TITLE_LENGTH = 80

# --- fixed values: assistant traces ------------------------------------------
REQUIRED_STEP_BY_ROUTE = {"swot": "save_swot_analysis"}
