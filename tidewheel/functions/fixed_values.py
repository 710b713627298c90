"""Lists, patterns and limits that results depend on, stated as they are."""

# --- fixed values: URL normalisation -------------------------------------------------
TRACKING_PARAMS = [
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "yclid", "ysclid", "igsh", "igshid", "tiktok_rider", "ttclid", "gad_source",
    "gad_campaignid", "cmpid", "cvid", "ogclid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "referrer", "fb_ref", "fb_source", "share_source",
    "share_medium", "share_id", "spm", "scm", "branch_match_id", "oly_anon_id", "oly_enc_id",
]
TRACKING_PREFIXES = [
    "utm_", "hsa_", "pk_", "mc_", "elq", "vero_", "trk", "_ga", "_gl", "_branch", "orchestrator_",
]
MAX_URL_LENGTH, MAX_URL_SLASHES = 300, 12

# --- fixed values: text cleaning (Java syntax, (?U) for Unicode classes) ---------------
HTML_TAG = r"(?i)</?[a-z](?U:[\w-]*\s*)[^>]*>"
ENGAGEMENT = [
    r"(?iU)\b(?:like|share|retweet|RT|subscribe|follow\s+(?:us|our|for)|join\s+(?:our\s+)?(?:channel|group)|turn\s+on\s+notifications|enable\s+post\s+notifications|hit\s+the\s+bell|smash\s+that\s+\w+|click\s+the\s+link\s+in\s+bio|link\s+in\s+bio|tap\s+the\s+link|tag\s+a\s+friend|comment\s+below|forward\s+this)\b[:!,.\s]*",
    r"(?iU)@\w{3,}",
    r"(?iU)\b(?:https?://)?t\.me/\S+",
]
EMOJI = r"\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}"
URL = r"(?i)https?://(?U:[^\s<>\"')\]]+)"

# --- fixed values: prefilter ------------------------------------------------------------
JUNK_TITLE = r"(?i)^(page not found|404|access denied|sign in|log ?in|forbidden|just a moment|are you a human|verify you are human|cloudflare|attention required|too many requests|rate limit(ed)?|unauthorized)\b"
JUNK_BODY = r"(?i)(enable javascript to (continue|view)|checking your browser|ddos protection by cloudflare|this page (isn.t working|doesn.t exist)|error 404|http 404|page (has been )?(removed|deleted)|no longer available|campaign has ended|offer (has )?ended|sold out)"
DEAL_SIGNAL = r"(?i)(free|credit|promo|coupon|discount|deal|trial|tier|student|grant|lifetime|off\b|code:?\s*\w|api[\s_-]?key|giveaway|voucher)"
MIN_TEXT = 24

# --- fixed values: signals and noise ----------------------------------------------------
NOISE_HOSTS = [
    "linktree.me", "linktr.ee", "bento.me", "t.me", "instagram.com", "twitter.com", "x.com", "tiktok.com", "youtube.com", "facebook.com", "linkedin.com",
    "beacons.ai", "bio.link", "taplink.cc", "fonts.googleapis.com", "schema.org", "ogp.me",
]
DEAL_HINTS = [
    "free", "credit", "promo", "deal", "discount", "coupon", "pack", "student", "tier", "trial", "offer", "resource", "course", "api", "tool", "kit",
    "grant", "access", "launch",
]
GITHUB_REPO = r"https?://github\.com/(?!(?:login|signup|explore|topics|trending|features|marketplace|pricing))([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
SIGNALS = [  # the first that is found gives the label
    ("llm_api_drop", r"(?i)(?:base[\s_-]?url\s*[=:]\s*https?://\S+|api[\s_-]?key\s*[=:]\s*[A-Za-z0-9_\-]{20,}|(?:venice|opencode|openrouter|together|groq|fireworks|deepseek)[\s.-]ai\b|deepseek[\s.-]?v\d|qwen[\s.-]?\d|free\s+(?:api|llm|model)\s+(?:key|access|credits?))"),
    ("llm_api_drop", r"(?i)(?:free\s+api\s+credits?\s*(?:no\s+credit\s+card|without\s+card)?|\$\d+\s+in\s+free\s+(?:credits?|tokens?)|register\s+(?:and\s+get|to\s+get)\s+free|openai[\s-]compatible\s+api.*free|no\s+credit\s+card\s+(?:required|needed)|(?:free|unlimited)\s+(?:tokens?|requests?)\s+(?:per\s+)?day|daily\s+reset.*free)"),
    ("saas_deal", r"(?i)(?:lifetime\s+(?:deal|access|license)|100\s*%\s+off|(?:free\s+)?(?:1|one)\s+year\s+(?:free|premium|pro|subscription)|appsumo\b|saasmantra\b|pitchground\b|dealmirror\b)"),
    ("coupon", r"(?i)(?:promo\s*(?:code|:)\s*[A-Z0-9_\-]{3,}|coupon\s*(?:code|:)\s*[A-Z0-9_\-]{3,}|use\s+(?:code|coupon)\s+[A-Z0-9_\-]{3,}|\d+\s*%\s+off\s+(?:with|code)|1\s*year\s+free|heygen\s+trick|lifetime\s+(?:deal|access|free)|appsumo\b)"),
    ("coupon", r"(?i)(?:(?:promo|coupon|invite|discount)\s+(?:code\s*)?[:\-]\s*([A-Z0-9_\-]{4,25})|use\s+(?:code|coupon)\s+([A-Z0-9_\-]{4,25})|code\s*:\s*([A-Z][A-Z0-9_\-]{3,24}))"),
    ("open_source_repo", r"(?i)(?:open[\s-]?source\s+alternative\s+to|replaces?\s+(?:cursor|copilot|notion|linear|figma|jira|slack)|github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\s+(?:launched|released|v\d|star|fork)|show\s+hn\b|(?:just|today)\s+(?:launched|open[\s-]?sourced))"),
    ("open_source_repo", GITHUB_REPO),
    ("student_pack", r"(?i)(?:\.edu\.pk\b|\.edu\.bd\b|\bNY\s+IP\b|free\s+google\s+ai\s+pro|gemini\s+(?:pro\s+)?free|google\s+one\s+ai|github\s+student|github\s+education|jetbrains\s+student|figma\s+(?:for\s+)?education|student\s+(?:developer\s+)?pack)"),
]
PROMO_CODE = SIGNALS[4][1]
HIGH_SIGNAL_SECTIONS = [
    "major cloud providers", "cloud management solutions", "source code repos", "apis, data and ml", "artificial intelligence", "paas", "baas", "low-code platform", "web hosting", "dns", "domain", "ide and code editing",
    "analytics, events and statistics", "email", "font", "forms", "storage and media processing", "design and ui", "security and pki", "authentication, authorization and user management", "serverless", "testing", "ci and cd",
    "monitoring", "crash and exception handling", "log management", "translation management", "feature toggles management platforms", "remote desktop tools", "game development", "education and career development",
    "payment and billing integration", "docker related", "vagrant related", "other free resources",
]
MARKDOWN_SKIP_HOSTS = ["github.com", "raw.githubusercontent.com", "shields.io", "img.shields.io"]

# --- fixed values: feed relevance ---------------------------------------------------------
REDDIT_FLAIRS = ["free", "deal", "resource", "freebie", "tools", "promo", "offer", "announcement", "project", "show hn"]
REDDIT_KEYWORDS = [
    "free tier", "free credits", "free api", "student pack", "promo code", "coupon", "discount", "free hosting", "free vps", "free domain", "free course", "free license", "free trial", "open source", "no credit card", "cursor", "lovable",
    "manus", "replit", "github education", "aws free", "gcp free", "azure free", "vercel free", "railway free", "supabase free", "netlify free", "cloudflare free", "hetzner", "fly.io free",
]
DEVTO_TAGS = ["opensource", "devtools"]
DEVTO_KEYWORDS = ["free", "open source", "open-source", "self-host", "self host", "credits", "free tier", "no credit card", "promo", "coupon", "discount", "lifetime", "student", "launch", "release", "alternative to", "api key"]
LAUNCH_KEYWORDS = [
    "free", "open source", "open-source", "self-host", "self host", "api", "sdk", "developer", "dev tool", "devtool", "cli", "framework", "no code", "no-code", "credits", "free tier", "freemium", "beta", "ai", "llm", "coding", "database",
    "hosting", "deploy", "automation", "lifetime", "student", "boilerplate", "template", "plugin", "library",
]

# --- fixed values: taxonomy (key, emoji, colour, description) --------------------------------
CATEGORIES = [
    ("cloud", "☁️", 0x0EA5E9, "AWS/GCP/Azure/DigitalOcean/Hetzner/Fly.io free tiers and credits"),
    ("llm", "🧠", 0x8B5CF6, "General LLM API free tiers (OpenAI, Anthropic, Groq, Together, etc.)"),
    ("llm_api_drop", "🔑", 0x6D28D9, 'Specifically: unofficial/limited-time free API keys, base URL drops, "use my key" style shares, rate-limited shared endpoints'),
    ("hosting", "🖥️", 0xF59E0B, "Web hosting, PaaS, static sites (Vercel, Netlify, Railway, Render)"),
    ("domain", "🌐", 0x10B981, "Free or discounted domain registrations"),
    ("tools", "🧰", 0x6366F1, "General developer tools, databases, CI/CD, monitoring"),
    ("student", "🎓", 0xEC4899, "Broad student benefit programs (GitHub Education, JetBrains, etc.)"),
    ("student_pack", "🎒", 0xDB2777, "Specific curated student pack deals (.edu, .edu.pk, geo-restricted student offers)"),
    ("course", "📚", 0x14B8A6, "Online courses, bootcamps, certifications"),
    ("coupon", "🏷️", 0xEF4444, "One-off discount/promo codes for any dev product"),
    ("ai_tools", "🤖", 0xA855F7, "AI-coding tools with free tiers (Cursor, Lovable, Manus, Windsurf, v0, Bolt, Replit)"),
    ("coding_agents", "⚡", 0xF97316, "Autonomous coding-agent platforms or IDE plugins with promo tiers"),
    ("open_source_repo", "📦", 0x22C55E, "Free open-source projects (GitHub repos) that replace paid tools"),
    ("saas_deal", "💼", 0xF59E42, 'SaaS lifetime deals, AppSumo-style offers, "1 year free" promotions'),
    ("notable_repo", "🌟", 0x2DD4BF, "Genuinely notable / trending open-source repo surfaced for discovery (not a deal). Item-4b non-deal lane; kept out of Discord dispatch until enabled. Emitted ONLY for items marked extra.is_repo."),
    ("other", "✨", 0x64748B, "Anything that doesn't fit above"),
]
OFFER_TYPES = ["credit", "grant", "vps", "domain", "license", "subscription", "code", "giveaway", "other"]

# --- fixed values: liveness, dispatch --------------------------------------------------------
SOFT_DEAD = ["expired", "no longer available", "campaign has ended", "offer ended", "sold out", "page not found"]
FENCE_OPEN, FENCE_CLOSE = "<<<UNTRUSTED_POST_TEXT>>>", "<<<END_UNTRUSTED_POST_TEXT>>>"
CHANNELS = ["discord", "email", "web"]
LEASE_MINUTES, MAX_RECLAIM, DAILY_CAP = 15, 20, 8
LIMITS = {"title": 256, "description": 4096, "field_value": 1024}
STOP_WORDS = [
    "the", "for", "and", "with", "from", "your", "you", "this", "that", "are", "was", "has", "have", "all", "any", "can", "get", "use", "new", "via",
    "not", "but", "app", "api", "ml", "llm", "tool", "tools", "open", "source", "free", "github", "repo", "repos", "cli", "sdk", "lib", "library",
    "framework", "based", "using", "model", "models", "project", "code", "data", "self", "hosted", "awesome", "list", "simple", "fast", "best",
]

#: Small letters whose capital is one character by Unicode's simple mapping and several by the full one, and those capitals.
SMALL, CAPITAL = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"
#: Small letters that got a capital in Unicode 16 only, which some engines do not know.
WITHOUT_CAPITAL = ("ƛ", "ɤ")
