"""Fixed values that results depend on: word lists, patterns and tables.

Everything here is data, kept in one place and in natural order.
"""

# ── Fixed values: URLs ──────────────────────────────────────────────────
MULTI_PART_TLDS = ["co.uk", "com.au", "co.jp", "org.uk", "com.br", "co.in", "co.nz"]

DOCS_SUBDOMAINS = [
    "docs", "doc", "learn", "guide", "guides", "reference", "api", "wiki", "help",
    "support", "kb", "knowledge", "manual", "handbook", "tutorial", "tutorials",
    "getting-started",
]

DOCS_PATH_SEGMENTS = [
    "docs", "doc", "documentation", "guide", "guides", "learn", "reference", "help",
    "wiki", "manual", "knowledge", "kb", "api", "tutorials", "resources",
]

NON_DOC_URL_PARTS = [
    "/blog/", "/news/", "/press/", "/about/", "/pricing/", "/careers/", "/contact/",
    "/signup/", "/login/", "/checkout/", "/cart/", "/landing/", "/campaign/",
    "/newsletter/", "/events/", "/webinar/", "/podcast/", "/community/", "/forum/",
    "/support/tickets/", "/store/", "/shop/",
]

SLUG_ALLOWED_TERMS = [
    "api", "cli", "sdk", "cdn", "url", "uri", "sql", "css", "html", "json", "xml",
    "yaml", "jwt", "oauth", "async", "sync", "auth", "config", "init", "env", "repo",
    "src", "dist", "dev", "prod", "docs", "utils", "webhook", "frontend", "backend",
    "middleware", "microservice", "kubernetes", "nginx", "redis", "v1", "v2", "v3",
    "next", "latest", "beta", "alpha", "guides", "guide", "tutorial", "tutorials",
    "htm", "php", "jsp", "aspx", "pdf", "md", "txt", "quickstart", "getting",
    "started", "getstarted", "intro", "overview", "faq", "faqs",
]

SLUG_TYPOS = {
    "steteful": "stateful",
    "configration": "configuration",
    "authenication": "authentication",
    "initalize": "initialize",
    "asyncronous": "asynchronous",
    "retreive": "retrieve",
    "recieve": "receive",
    "occured": "occurred",
    "seperate": "separate",
    "enviroment": "environment",
    "persistance": "persistence",
    "refrence": "reference",
    "defintion": "definition",
    "exection": "execution",
    "implmentation": "implementation",
    "documention": "documentation",
    "compatiblity": "compatibility",
    "availablity": "availability",
    "performace": "performance",
}

RELATED_DOMAIN_GROUPS = [
    ["x.com", "twitter.com"],
    ["github.com", "github.io", "githubapp.com"],
    ["google.com", "googleapis.com", "googleusercontent.com", "gstatic.com"],
    ["amazon.com", "amazonaws.com", "awsstatic.com"],
    ["microsoft.com", "microsoftonline.com", "azure.com", "office.com"],
    ["facebook.com", "fbcdn.net", "instagram.com"],
    ["atlassian.com", "atlassian.net", "bitbucket.org"],
    ["salesforce.com", "force.com", "herokuapp.com"],
]

DOMAIN_ALIASES = {"knock.app": "docs.knock.app"}

DOCS_URL_PATTERN = r"/docs/|/documentation/|/guide|/tutorial|/api/|/reference|/getting-started|/quickstart"
DOCS_PREVIEW_PATTERN = r"/docs/|/documentation/|/guide|/tutorial|/api/|/reference"
ASSET_URL_PATTERN = r"\.(jpg|png|gif|svg|css|js|pdf|zip|ico)$"

# ── Fixed values: page features ─────────────────────────────────────────
SCHEMA_TYPES = [
    "Article", "TechArticle", "HowTo", "FAQPage", "APIReference", "WebPage", "WebSite",
    "SoftwareApplication", "CreativeWork", "LearningResource", "Course", "BlogPosting",
]

SCHEMA_REQUIRED = {
    "Article": ["headline", "author", "datePublished"],
    "TechArticle": ["headline", "author", "datePublished"],
    "HowTo": ["name", "step"],
    "FAQPage": ["mainEntity"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "WebPage": ["name"],
    "WebSite": ["name", "url"],
}

OG_REQUIRED = ["og:title", "og:description", "og:image", "og:type"]

API_URL_PARTS = ["/api/", "/reference/", "/sdk/", "/endpoint", "/rest/", "/graphql/"]
GUIDE_URL_PARTS = ["/guide", "/tutorial", "/getting-started", "/quickstart", "/how-to", "/walkthrough"]

LOADING_PREFIXES = [
    "loading", "please wait", "styles are loading", "initializing", "redirecting",
    "just a moment", "checking your browser", "enable javascript",
]

MODEL_PAGE_TYPES = [
    "api-reference", "tutorial", "conceptual", "how-to", "overview", "reference",
    "troubleshooting", "changelog", "mixed", "blog-post", "landing-page",
    "marketing-page", "non-documentation",
]

SUMMARY_DOC_TYPES = [
    "api-reference", "tutorial", "conceptual", "how-to", "reference",
    "troubleshooting", "overview", "changelog", "mixed",
]

# (page type, words looked up in url + title, words looked up in the title only)
KEYWORD_PAGE_TYPES = [
    ("api-reference", ["/reference/functions/", "/reference/classes/", "/reference/hooks/"], ["()", "function", "hook"]),
    ("tutorial", ["getting-started", "/tutorial"], ["tutorial", "getting started"]),
    ("conceptual", ["/explanations/", "/architecture/"], ["architecture", "understanding", "explanation"]),
    ("how-to", ["how-to", "/guides/"], ["how to", "create"]),
    ("overview", ["/intro", "introduction"], ["introduction", "intro"]),
    ("reference", ["/reference-guides/", "/reference/"], ["reference"]),
    ("troubleshooting", ["/troubleshooting/", "/faq/"], ["troubleshoot", "faq"]),
    ("changelog", ["/changelog/", "/releases/"], ["changelog", "release"]),
]

# Documentation-confidence signals: (name, weight, pattern), patterns case-insensitive.
DOC_URL_SIGNALS = [
    ("/docs/", 2, r"/docs?/"),
    ("/api/", 2, r"/api/"),
    ("/reference/", 2, r"/reference/"),
    ("/guide", 2, r"/guide"),
    ("/tutorial", 2, r"/tutorial"),
    ("/sdk/", 2, r"/sdk/"),
    ("/getting-started", 2, r"/getting-?started"),
    ("/quickstart", 2, r"/quickstart"),
    ("/develop/", 2, r"/develop/"),
    ("/learn/", 2, r"/learn/"),
    ("/manual/", 2, r"/manual/"),
    ("/handbook/", 2, r"/handbook/"),
    ("/wiki/", 2, r"/wiki/"),
    ("/changelog", 2, r"/changelog"),
    ("/release-notes", 2, r"/release-notes"),
    ("/help/", 2, r"/help/"),
    ("readme.io", 3, r"readme\.io"),
    ("gitbook.io", 3, r"gitbook\.io"),
    ("readthedocs", 3, r"readthedocs"),
    ("swagger", 3, r"swagger"),
    ("mintlify", 3, r"mintlify"),
    ("docusaurus", 3, r"docusaurus"),
    ("stoplight.io", 3, r"stoplight\.io"),
    ("redoc", 3, r"redoc"),
    ("apiary.io", 3, r"apiary\.io"),
    ("postman", 3, r"postman\.com"),
    ("doc subdomain", 2, r"^https?://(developer|docs|dev|api|learn|support)\."),
    ("non-doc /pricing", -2, r"/pricing"),
    ("non-doc /customers", -2, r"/customers"),
    ("non-doc /careers", -2, r"/careers"),
    ("non-doc /about", -2, r"/about/?$"),
    ("non-doc /landing", -2, r"/landing"),
    ("non-doc /press", -2, r"/press"),
    ("non-doc /contact", -2, r"/contact"),
    ("non-doc /design/", -2, r"/design/"),
    ("non-doc /blog/", -2, r"/blog/"),
    ("non-doc /stories/", -2, r"/stories/"),
    ("non-doc /community/", -2, r"/community/"),
    ("non-doc /events/", -2, r"/events/"),
    ("non-doc /news/", -2, r"/news/"),
    ("non-doc /solutions/", -2, r"/solutions/"),
    ("non-doc /platform/", -2, r"/platform/"),
    ("non-doc /products/", -2, r"/products/"),
    ("non-doc /samples", -2, r"/samples/?$"),
    ("non-doc /showcase", -2, r"/showcase"),
    ("non-doc /gallery", -2, r"/gallery"),
    ("non-doc /examples", -2, r"/examples/?$"),
    ("non-doc /templates", -2, r"/templates/?$"),
    ("non-doc /catalog", -2, r"/catalog"),
]

# the first of these that matches counts, the others do not
DOC_PLATFORM_SIGNALS = [
    ("doc platform fingerprint", 3, r"mintlify|fern-docs|gitbook-root|docsearch-input"),
    ("doc framework detected", 3, r"docusaurus|nextra-body|algolia-docsearch"),
    ("API doc framework", 3, r"swagger-ui|redoc-wrap|stoplight-elements"),
]
DOC_INSTALL_PATTERN = r"npm install|pip install|yarn add|cargo add|gem install|brew install"
DOC_HTML_SIGNALS = [
    ("main element", 1, r"<main[\s>]|role=[\"']main[\"']"),
    ("docsearch meta", 2, r"<meta[^>]*name=[\"']docsearch"),
    ("data-docs attribute", 1, r"data-docs"),
    ("install commands", 2, DOC_INSTALL_PATTERN),
    ("pricing table", -2, r"<table[^>]*>[\s\S]*?(price|/month|/year|enterprise|starter|pro plan)"),
    ("feature grid", -1, r"feature[-_]?grid|feature[-_]?card|benefit[-_]?card|use[-_]?case"),
    (
        "pagination", -2,
        r"class=[\"'][^\"']*pagination[\"']|aria-label=[\"']pagination[\"']|page\s+\d+\s+of\s+\d+"
        r"|<nav[^>]*>[\s\S]*?<a[^>]*>\d+</a>[\s\S]*?<a[^>]*>\d+</a>",
    ),
    ("filter ui", -2, r"filter[-_]?bar|filter[-_]?panel|facet|search[-_]?filter|select\s+all|checkbox.*filter"),
]

# (name, weight, pattern, smallest count that fires)
DOC_COUNT_SIGNALS = [
    ("code blocks", 3, r"<pre[\s>]", 1),
    ("inline code", 1, r"<code[\s>]", 3),
    ("marketing ctas", -2, r"buy now|contact sales|book a demo|free trial|sign up free|get started free", 2),
    ("hero layout", -2, r"hero[-_]?section|hero[-_]?banner|cta[-_]?button|testimonial|social[-_]?proof|customer[-_]?logo", 2),
    ("overview ctas", -1, r"explore\s+\w+|discover\s+\w+|learn\s+more|view\s+samples|browse\s+\w+|try\s+it\s+out", 3),
]
DOC_ANCHOR_PATTERN = r"href=[\"']#[a-zA-Z]"
DOC_CARD_GRID_PATTERN = (
    r"card[-_]?grid|card[-_]?container|card[-_]?list|grid[-_]?container|item[-_]?grid"
    r"|sample[-_]?card|resource[-_]?card"
)
DOC_CARD_PATTERN = r"<div[^>]*class=[\"'][^\"']*card[\"'][^>]*>"
DOC_OUTBOUND_PATTERN = r"<a\s[^>]*href=[\"']https?://"
DOC_API_WORDS_PATTERN = (
    r"api reference|endpoint|request body|response body|authentication|authorization header|bearer token"
)

# ── Fixed values: robots.txt and probes ─────────────────────────────────
AI_CRAWLERS = [
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-Web",
    "PerplexityBot", "Amazonbot", "Bingbot", "Bytespider", "Google-Extended",
    "CCBot", "anthropic-ai", "Omgilibot",
]

EXPECTED_CONTENT_TYPES = {
    "llms.txt": ["text/plain", "text/markdown", "application/octet-stream"],
    "llms-full.txt": ["text/plain", "text/markdown", "application/octet-stream"],
    "AGENTS.md": ["text/plain", "text/markdown", "application/octet-stream"],
    "mcp.json": ["application/json", "text/json"],
    "sitemap.xml": ["application/xml", "text/xml"],
    "markdown-alternate": ["text/markdown", "text/plain"],
    "direct-md": ["text/markdown", "text/plain", "application/octet-stream"],
}

# ── Fixed values: scores ────────────────────────────────────────────────
DIMENSIONS = ["relevance", "freshness", "clarity", "accuracy", "completeness"]

# weight of every dimension, in the order above
CONTENT_TYPE_WEIGHTS = {
    "api-reference": [0.15, 0.25, 0.20, 0.30, 0.10],
    "tutorial": [0.20, 0.20, 0.30, 0.20, 0.10],
    "conceptual": [0.25, 0.10, 0.35, 0.20, 0.10],
    "how-to": [0.25, 0.15, 0.25, 0.25, 0.10],
    "overview": [0.30, 0.15, 0.30, 0.15, 0.10],
    "reference": [0.15, 0.20, 0.20, 0.35, 0.10],
    "troubleshooting": [0.25, 0.20, 0.25, 0.25, 0.05],
    "changelog": [0.20, 0.35, 0.20, 0.20, 0.05],
    "product-guide": [0.20, 0.15, 0.35, 0.20, 0.10],
    "mixed": [0.20, 0.20, 0.25, 0.25, 0.10],
}

GRADES = [("A+", 95), ("A", 90), ("B+", 85), ("B", 75), ("C", 60), ("D", 40)]

PRIORITY_ORDER = {"high": 0, "medium": 1, "low": 2, "best-practice": 3}

CITATION_WEIGHT = 30

LEGACY_AGENTS = ["GPTBot", "Claude-Web", "CCBot", "Google-Extended"]

# ── Fixed values: issues ────────────────────────────────────────────────
DOCS_LABELS = ["documentation", "docs", "doc", "type: docs", "area: docs", "area: documentation"]
STRONG_DOCS_SIGNALS = [
    "documentation", "docs ", "docs.", "readme", "guide", "tutorial", "not documented", "undocumented",
    "typo in doc", "broken link", "api reference", "developer guide", "getting started", "changelog",
]
MEDIUM_DOCS_SIGNALS = [
    "unclear", "confusing", "misleading", "incorrect example", "missing docs", "missing documentation",
    "missing example", "how to", "how do i", "where is the doc", "needs documentation",
    "update documentation", "improve documentation", "document this", "not clear",
]

# the wider local classifier
LOCAL_DOCS_SIGNALS = [
    "documentation", "docs", "readme", "guide", "tutorial", "example", "unclear", "confusing", "misleading",
    "incorrect", "wrong", "inaccurate", "outdated", "missing", "how to", "how do i", "skill.md", "skill",
    "not documented", "undocumented", "typo", "broken link",
]
LOCAL_DOCS_LABELS = ["documentation", "docs", "bug", "type: bug", "good first issue"]

STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was",
    "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could",
    "may", "might", "must", "can",
]
CATEGORY_KEYWORDS = {
    "deployment": ["deploy", "production", "environment", "vercel", "netlify", "hosting"],
    "email-delivery": ["email", "spam", "deliverability", "dns", "spf", "dkim", "gmail"],
    "api-usage": ["api", "endpoint", "request", "response", "integration"],
    "authentication": ["auth", "key", "token", "credential", "permission"],
    "documentation": ["docs", "guide", "tutorial", "example"],
}
PRODUCTION_WORDS = ["production", "deploy", "environment", "configuration", "setup"]

ISSUE_CATEGORIES = [
    ("rate-limiting", ["rate limit", "too many requests", "429 error", "throttling", "quota exceeded"]),
    ("authentication", ["auth", "api key", "token", "unauthorized", "401 error", "permission denied"]),
    ("code-examples", ["example", "sample code", "how to", "tutorial", "implementation"]),
    ("api-usage", ["api", "endpoint", "request", "response", "integration"]),
    ("deployment", ["production", "deploy", "environment", "config", "setup"]),
    ("webhooks", ["webhook", "callback", "event", "notification", "trigger"]),
    ("error-handling", ["error", "exception", "failure", "bug", "issue"]),
    ("documentation", ["docs", "documentation", "unclear", "missing", "outdated"]),
]

PRODUCT_CATEGORIES = [("knock.app", "notification-api"), ("resend.com", "email-api"), ("liveblocks.io", "realtime-infra")]
# (product category, audit id, title, issue category, frequency, severity)
PROACTIVE_AUDITS = [
    ("notification-api", "audit-idempotency", "Audit: Idempotency Key Implementation", "api-usage", 90, "high"),
    ("notification-api", "audit-batch-limits", "Audit: Batch Triggering Limits", "api-usage", 85, "high"),
    ("notification-api", "audit-prod-security", "Audit: Production Environment Security", "authentication", 95, "high"),
]

DOCS_REPO_NAME_PATTERN = (
    r"(?i)\bdocs\b|\bdocumentation\b|\bdoc[-_]site\b|dev[-_]?site\b|dev[-_]?portal\b|\bguide\b|\bwiki\b"
)
DOCS_REPO_DESC_PATTERN = (
    r"(?i)\bdocumentation\b|\bdocs?\s+(site|portal|repo)|\bdeveloper\s+(docs|portal|guide|site)\b"
    r"|\bdev\s+site\b|\bapi\s+(docs|reference)\b"
)
DOCS_REPO_TOPIC_PATTERN = r"(?i)\bdocs\b|\bdocumentation\b"
CODE_FILE_PATTERN = r"(?i)\.(ts|tsx|js|jsx|vue|svelte)$"
BOILERPLATE_FILES = ["readme.md", "contributing.md", "changelog.md", "license.md", "code_of_conduct.md", "security.md"]
CONTENT_FOLDERS = ["docs", "documentation", "content", "wiki"]

SKIPPED_PLATFORMS = ["google.com", "youtube.com", "twitter.com", "x.com", "facebook.com"]

FIX_CATEGORIES = ["CODE_UPDATE", "LINK_FIX", "CONTENT_ADDITION", "VERSION_UPDATE", "FORMATTING_FIX"]

# ── Fixed values: usage ─────────────────────────────────────────────────
DAILY_LIMIT = 3
WAITLIST_BONUS = 7
MAX_PAYLOAD_BYTES = 120 * 1024
