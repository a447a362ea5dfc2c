"""Fixed values that results depend on: word lists, limits, weights and patterns, plainly and in natural order."""

# English function words that no phrase starts or ends with.
STOPWORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but "
    "by can could did do does doing down during each else ever every few for from further get gets got had has have having "
    "he her here hers herself him himself his how i if in into is it its itself just like may me might more most must my "
    "myself no nor not now of off on once only or other our ours ourselves out over own per same she should so some such than "
    "that the their theirs them themselves then there these they this those through to too under until up upon us very via "
    "was we were what when where which while who whom whose why will with within without would yet you your yours yourself "
    "yourselves vs etc one two new use using used make makes way ways learn read don't doesn't isn't aren't can't won't it's "
    "that's what's there's let's i'm you're we're they're you've we've you'll we'll"
).split()

# Elements whose end separates words, and elements that aren't content.
BLOCK_TAGS = "p div section li h1 h2 h3 h4 h5 h6 br td th blockquote pre dt dd figcaption".split()
NOISE_TAGS = "script style noscript svg template iframe nav header footer aside form dialog".split()

# What a phrase's appearance in a place weighs, strongest first, and the limits of picks.
SOURCE_WEIGHTS = {"title": 3.0, "h1": 3.0, "slug": 2.5, "schema": 2.0, "heading": 1.5, "meta": 1.5, "intro": 1.2}
MAX_KEYWORDS, MIN_SCORE, INTRO_WORDS, BODY_ONLY_WEIGHT, MAX_PHRASE_WORDS = 8, 2.0, 50, 0.5, 4

# Limits of the page rules.
TITLE_MIN, TITLE_MAX, THIN_WORDS, RENDERED_WORDS, LISTED_IMAGES = 30, 60, 300, 50, 10
VALUE_DIRECTIVES = ["max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"]
SEARCH_AGENTS = ["googlebot", "bingbot"]

# Discovery of a site's posts.
CONVENTIONAL_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml", "/sitemap/", "/blog/sitemap.xml"]
BLOG_WORDS = ["blog", "articles", "insights", "news", "resources", "journal", "stories"]
POSITIVE_TOKENS = ["blog", "blogs", "post", "posts", "article", "articles", "news", "stories"]
NEGATIVE_TOKENS = (
    "page pages product products category categories tag tags author authors image images video videos event events kb docs "
    "help academy course courses careers jobs pricing static tools apps"
).split()
ARCHIVE_SEGMENTS = ["category", "tag", "tags", "author", "authors", "topic", "topics", "search", "feed", "wp-json"]
GENERIC_NAME_WORDS = ["sitemap", "sitemaps", "index", "xml", "gz", "partition", "part"]
SAMPLE_SIZE, MAX_SITEMAP_FETCHES, FAMILIES_SAMPLED, MAX_INDEX_DEPTH, MIN_HUB_URLS, MAX_PARTS, POST_LIMIT = 500, 30, 6, 3, 5, 10, 15

# Address blocks that are not public.
BLOCKED_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
BLOCKED_IPV6 = [("::", 128), ("::1", 128), ("64:ff9b::", 96), ("100::", 64), ("2001:db8::", 32), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8)]

# Crawling.
RETRY_STATUSES = [429, 500, 502, 503, 504]
MAX_ATTEMPTS, MAX_REDIRECTS, MAX_RETRY_AFTER_MS, BASE_DELAY_MS, DEFAULT_DELAY_MS, MAX_DELAY_MS, MAX_BLOCKS = 3, 5, 30_000, 500, 1_000, 5_000, 3

# The rank history generator.
CAPTURE_TIME = "02:30:00"
NOT_RANKING, UPDATE_DAY = 0.05, 0.02

# Texts for failure codes and labels for phrase sources.
CRAWL_ERRORS = {
    "no_sitemap": "No sitemap was found: none listed in robots.txt works and the usual locations are missing.",
    "no_blog_found": "Sitemaps were found, but none of them lists blog posts.",
    "blocked_by_site": "The site refused the crawler (for example bot protection or rate limiting).",
    "site_unreachable": "The website did not respond or returned an error.",
    "timeout": "The website took too long to respond.",
    "blocked_host": "The address points to a private or internal network.",
    "too_large": "A response was too large to process.",
    "too_many_redirects": "The website redirects in a loop.",
    "invalid_url": "The website address is not valid.",
    "internal_error": "Something went wrong on our side while crawling.",
}

SOURCE_LABELS = {"title": "title", "h1": "H1", "slug": "URL", "schema": "structured data", "heading": "headings", "meta": "meta description", "intro": "intro", "body": "body text"}

# Reads.
PAGE_SIZE, MAX_PAGE_SIZE, MAX_QUERY, DEFAULT_RANGE_DAYS, MAX_RANGE_DAYS = 20, 100, 200, 90, 730
PRESET_RANGE_DAYS, DEFAULT_SERIES = [7, 30, 90, 365], 3
