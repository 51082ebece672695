"""Tag lists, patterns and word lists that define the results."""

# Elements that start on a line of their own in Markdown.
MD_BLOCKS = (
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex "
    "li main menu nav noframes noscript ol output p pre section table tbody td tfoot th "
    "thead tr ul"
).split()

# Elements without an end tag.
VOID_TAGS = (
    "area base br col command embed hr img input keygen link meta param source track wbr"
).split()

# Elements that say something even when empty.
MEANINGFUL_WHEN_BLANK = "a table thead tbody tfoot th td iframe script audio video".split()

# Elements whose start or end tag ends an open paragraph (HTML standard).
ENDS_PARAGRAPH = (
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl "
    "dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li "
    "main menu nav noframes ol p pre search section summary table tbody td tfoot th thead tr ul"
).split()

# Inline ("phrasing") elements; a, del and ins join them when their content is inline.
PHRASING = (
    "abbr audio b bdo br button cite code data datalist dfn em embed i img input kbd label mark "
    "math meter noscript object output progress q ruby samp script select small span strong sub "
    "sup textarea time var wbr"
).split()
PHRASING_BY_CONTENT = "a del ins".split()

# A div holding none of these is a paragraph.
DIV_TO_P_BLOCKS = "blockquote dl div img ol p pre table ul".split()
SCORED_TAGS = "section h2 h3 h4 h5 h6 p td pre".split()
KEEP_AS_SIBLING = "div article section p ol ul".split()
TEXTISH_TAGS = "span li td".split() + DIV_TO_P_BLOCKS
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
CONTENTLESS_TAGS = "div section header".split() + HEADINGS
UNLIKELY_ROLES = (
    "menu menubar complementary navigation alert alertdialog dialog"
).split()

# First score of a candidate by its tag.
TAG_SCORES = {
    5: "div".split(),
    3: "pre td blockquote".split(),
    -3: "address ol ul dl dd dt li form".split(),
    -5: HEADINGS + ["th"],
}

# Class and id patterns.
UNLIKELY = (
    r"(?i)-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|"
    r"gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|"
    r"sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
)
MAYBE_CANDIDATE = r"(?i)and|article|body|column|content|main|shadow"
POSITIVE = (
    r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
)
NEGATIVE = (
    r"(?i)-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|"
    r"masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|"
    r"sponsor|shopping|tags|widget"
)
BYLINE = r"(?i)byline|author|dateline|writtenby|p-author"
SHARE = r"(?i)(\b|_)(share|sharedaddy)(\b|_)"
VIDEOS = (
    r"(?i)//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq)\.com|"
    r"(archive|upload\.wikimedia)\.org|player\.twitch\.tv)"
)
AD_WORDS = r"(?iu)^(ad(vertising|vertisement)?|pub(licité)?|werb(ung)?|广告|Реклама|Anuncio)$"
LOADING_WORDS = r"(?iu)^((loading|正在加载|Загрузка|chargement|cargando)(…|\.\.\.)?)$"
BASE64_URL = r"(?i)^data:\s*([^\s;,]+)\s*;\s*base64\s*,"

# Commas of various scripts.
COMMAS = r"[\u002C\u060C\uFE50\uFE10\uFE11\u2E41\u2E34\u2E32\uFF0C]"

# Schema.org article types (only the first and the last are anchored).
JSON_LD_TYPES = (
    "^Article|AdvertiserContentArticle|NewsArticle|AnalysisNewsArticle|AskPublicNewsArticle|"
    "BackgroundNewsArticle|OpinionNewsArticle|ReportageNewsArticle|ReviewNewsArticle|Report|"
    "SatiricalArticle|ScholarlyArticle|MedicalScholarlyArticle|SocialMediaPosting|BlogPosting|"
    "LiveBlogPosting|DiscussionForumPosting|TechArticle|APIReference$"
)
SCHEMA_ORG = r"^https?://schema\.org/?$"

# Presentational attributes; the last two only on the listed elements.
PRESENTATIONAL = (
    "align background bgcolor border cellpadding cellspacing frame hspace rules style valign vspace"
).split()
SIZED_TAGS = "table th td hr pre".split()
KEPT_CLASSES = ["page"]

# Selectors cleaned out of every scope.
CLEAN_TAGS = "script style noscript nav footer".split()
CLEAN_CLASSES = "comments ads sidebar".split()
IMAGE_TAGS = "img picture svg".split()

# Hosts that load their content while scrolling.
LAZY_HOSTS = (
    "gemini.google.com aistudio.google.com chat.openai.com chatgpt.com claude.ai poe.com "
    "perplexity.ai copilot.microsoft.com"
).split()

# Addresses that only a browser can show.
BROWSER_SCHEMES = ["chrome://", "edge://", "about:", "chrome-extension://", "moz-extension://"]

# Messages of failed conversions.
ERROR_MESSAGES = {
    "NO_CONTENT": "No content could be extracted from this page.",
    "NO_SELECTION": (
        "No text is selected. Please select text or use a different content scope."
    ),
    "PERMISSION_DENIED": "Permission denied. Please check extension permissions.",
    "GENERAL": "An error occurred during conversion.",
}
NO_SELECTION = "No text is selected"
NO_CONTENT = "No content could be extracted"
EMPTY_MARKDOWN = "Conversion resulted in empty markdown"
NOTHING_CONVERTED = "No tabs were successfully converted"
FRAME_NOTE = (
    "\n\n---\n> **Note:** This page contains %d cross-origin iframe(s) that could not be "
    "accessed due to browser security policies. Some content may be missing. Links to these "
    "iframes have been preserved where possible.\n"
)
LARGE_BATCH = 20
MERGE_SEPARATOR = "\n\n---\n\n"
MAX_FILE_NAME = 100

# Meta names in order of preference.
META_TITLE = (
    "dc:title dcterm:title og:title weibo:article:title weibo:webpage:title title "
    "twitter:title parsely-title"
).split()
META_BYLINE = "dc:creator dcterm:creator author parsely-author".split()
META_EXCERPT = (
    "dc:description dcterm:description og:description weibo:article:description "
    "weibo:webpage:description description twitter:description"
).split()
META_SITE = ["og:site_name"]
META_TIME = "article:published_time parsely-pub-date".split()

# Fixed values: (attribute, value) selectors used when the article has no such metadata.
FALLBACK_AUTHOR = [
    ("name", "author"), ("property", "article:author"), ("name", "dcterms.creator"),
    ("name", "DC.creator"), ("property", "og:author"),
]
FALLBACK_SITE = [
    ("property", "og:site_name"), ("name", "application-name"),
    ("name", "apple-mobile-web-app-title"),
]
FALLBACK_DATE = [
    ("property", "article:published_time"), ("name", "dcterms.created"),
    ("name", "DC.date.created"), ("name", "date"), ("property", "og:published_time"),
]
META_PROPERTY = (
    r"(?i)\s*(article|dc|dcterm|og|twitter)\s*:\s*"
    r"(author|creator|description|published_time|title|site_name)\s*"
)
META_NAME = (
    r"(?i)^\s*(?:(dc|dcterm|og|twitter|parsely|weibo:(article|webpage))\s*[-.:]\s*)?"
    r"(author|creator|pub-date|description|title|site_name)\s*$"
)

# Media tags whose addresses are resolved in an article.
MEDIA_TAGS = ["img", "picture", "figure", "video", "audio", "source"]

# Containers that are collapsed when nested, and what attribute values of a lazily loaded image look like.
NESTED_CONTAINERS = ["div", "section"]
IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|webp)"
LAZY_SRCSET = r"\.(jpg|jpeg|png|webp)\s+\d"
LAZY_SRC = r"^\s*\S+\.(jpg|jpeg|png|webp)\S*\s*$"
