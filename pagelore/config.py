"""Settings of every stage, as frozen dataclasses with the compatible defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Word lists and patterns that decide results.
# ---------------------------------------------------------------------------

BLOCKED_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico",
    ".css", ".js", ".map",
    ".mp4", ".mp3", ".wav", ".avi", ".mov",
    ".zip", ".rar", ".7z", ".tar", ".gz",
    ".exe", ".dmg",
    ".woff", ".woff2", ".ttf", ".eot",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)

REMOVED_TAGS = (
    "script", "style", "noscript", "svg", "canvas", "iframe", "form", "template",
    "header", "footer", "nav",
)

NOISE_CLASSES = (
    "navbar", "nav-bar", "navigation", "site-nav", "main-nav", "mobile-nav", "menu",
    "footer", "header", "cookie", "cookies", "popup", "modal", "breadcrumb",
)

BLOCK_TAGS = (
    "div", "p", "ul", "ol", "li", "section", "article",
    "h1", "h2", "h3", "h4", "h5", "h6",
)

NOISE_HEADINGS = (
    r"^next step$",
    r"^get started$",
    r"^contact us$",
    r"^let'?s talk$",
    r"^talk to us$",
    r"^have a related business challenge\??$",
    r"^other services you may need\.?$",
    r"^related services$",
)

NOISE_TEXT_PREFIXES = (
    r"^tell us what you'?re dealing with",
    r"^we'?ll tell you honestly whether",
)

UI_TEXTS = (
    "skip to content",
    "menu",
    "close menu",
    "open menu",
    "cookie settings",
    "privacy policy",
    "terms of service",
)

SKIPPED_LINK_PREFIXES = ("#", "javascript:", "mailto:", "tel:")

BROAD_PATTERNS = (
    r"\bwhat services\b",
    r"\bwhich services\b",
    r"\bservices do you\b",
    r"\bservices does\b",
    r"\bwhat solutions\b",
    r"\bwhich solutions\b",
    r"\bsolutions do you\b",
    r"\bwhat do you offer\b",
    r"\bwhat does .* offer\b",
    r"\bwhat can .* help\b",
    r"\bwhat capabilities\b",
    r"\bwhat offerings\b",
    r"\bofferings\b",
    r"\bservices offered\b",
    r"\bsolutions offered\b",
    r"\bservice portfolio\b",
    r"\bservice offering\b",
)

TOPIC_TERMS = (
    "service", "services", "solution", "solutions", "offering", "offerings", "capabilities",
)

BROAD_TERMS = ("what", "which", "offer", "provide", "provides", "do", "does")

TITLE_SIGNALS = ("services", "solutions")


@dataclass(frozen=True)
class CrawlConfig:
    """Which site is crawled, and how politely."""

    canonical_host: str
    bare_host: str = ""
    max_pages: int | None = 1000
    delay_seconds: float = 0.3
    timeout_seconds: float = 20.0
    fetch_parallelism: int = 8
    min_document_words: int = 20
    blocked_extensions: tuple[str, ...] = BLOCKED_EXTENSIONS
    user_agent: str = "Mozilla/5.0 (compatible; pagelore)"
    # Further request headers, as (name, value).
    headers: tuple[tuple[str, str], ...] = ()

    @property
    def start_url(self) -> str:
        return f"https://{self.canonical_host}/"


@dataclass(frozen=True)
class ChunkConfig:
    target_words: int = 180
    max_words: int = 260
    min_chunk_words: int = 20
    small_section_words: int = 35
    overlap_words: int = 30
    chunker_version: str = "2.0"
    # The section body repeats its own parts by default; True keeps each part once.
    dedupe_content: bool = False

    def __post_init__(self) -> None:
        if self.target_words < 1 or self.max_words < 1:
            raise ValueError("target_words and max_words must be at least 1")

    @property
    def window(self) -> int:
        return min(self.target_words, self.max_words)

    @property
    def step(self) -> int:
        return max(self.window - self.overlap_words, 1)


@dataclass(frozen=True)
class EmbedConfig:
    dimension: int = 384
    batch_size: int = 32
    model: str = "hashed-bag-of-words"
    version: str = "1.0"


@dataclass(frozen=True)
class IntentConfig:
    """What makes a question broad, and which pages then have to be covered."""

    patterns: tuple[str, ...] = BROAD_PATTERNS
    topic_terms: tuple[str, ...] = TOPIC_TERMS
    broad_terms: tuple[str, ...] = BROAD_TERMS
    title_signals: tuple[str, ...] = TITLE_SIGNALS
    overview_url: str = ""
    coverage_urls: tuple[str, ...] = ()
    rows_per_url: int = 3


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    candidate_k: int = 20
    mmr_lambda: float = 0.80
    max_per_document: int = 2
    broad_max_per_document: int = 1
    vector_weight: float = 0.75
    lexical_weight: float = 0.25
    overview_boost: float = 0.15
    coverage_boost: float = 0.08
    title_boost: float = 0.03
    document_boost: float = 0.02
    intent: IntentConfig = field(default_factory=IntentConfig)
    # Scores are compared after rounding, so sums taken in another order still tie.
    score_decimals: int = 9
    # Bytes of question vectors held by one task; more questions mean more passes.
    question_block_bytes: int = 64 << 20
    # Candidate rows that may be broadcast for the payload lookup.
    broadcast_rows: int = 200_000

    def __post_init__(self) -> None:
        if self.top_k <= 0:
            raise ValueError("top_k must be greater than 0")
        if self.candidate_k < self.top_k:
            raise ValueError("candidate_k must be >= top_k")
        if not 0.0 <= self.mmr_lambda <= 1.0:
            raise ValueError("mmr_lambda must be between 0 and 1")


@dataclass(frozen=True)
class AnswerConfig:
    knowledge_base: str = "site"
    max_question_chars: int = 2000
    # What the model is told; {knowledge_base} and {fallback} are filled in.
    instructions: str = (
        "You are the search desk of the {knowledge_base} knowledge base. Reply in a few plain sentences, "
        'backed by the passages that follow. Should they not settle the question, your whole reply is: "{fallback}"'
    )

    @property
    def fallback(self) -> str:
        return f"I couldn't find that information in the {self.knowledge_base} knowledge base."
