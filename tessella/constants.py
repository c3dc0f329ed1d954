"""Values that the engine chooses. None is tuned to a table; each is one place to change."""

SCHEMA_VERSION = 5
EXTRACTOR_VERSION = 1

# Ranking
TOP_K, ASK_K, MAX_FILES, MAX_NEIGHBOURS = 8, 5, 8, 8
MAX_SEEDS, SEED_RATIO, APPENDED_ROWS = 3, 0.2, 4
PROSE_WEIGHT, MODULE_WEIGHT, BREADTH_WEIGHT, DEGREE_WEIGHT = 1.5, 2.0, 0.5, 0.25
TAIL_WEIGHT, PATH_WEIGHT, GENERIC_WEIGHT = 0.45, 0.55, 0.8
RRF_K, NOISE_FLOOR, POOL = 60, 0.25, 24
MAX_SYMBOLS, MAX_NAMES = 20, 60
EMBED_CHARS = 4000

# Graph
HUB_LEAST, HUB_QUANTILE = 50, 0.99
DAMPING, PAGERANK_ROUNDS = 0.85, 10
SURPRISE_EDGES, EXPAND_DEPTH, DELTA_DEPTH = 2, 2, 2

# Risk of a change: weight of each signal, and the least score of each bucket
RISK = {"exported": 25, "test_gap": 20, "dangling": 15, "blast_high": 20, "blast_medium": 10, "hub_high": 20, "hub_medium": 10, "surprise": 10}
BLAST_HIGH_FILES, BLAST_HIGH_MODULES, BLAST_MEDIUM_FILES, BLAST_MEDIUM_MODULES = 20, 5, 5, 3
HUB_HIGH, HUB_MEDIUM = 0.95, 0.8
BUCKET_HIGH, BUCKET_MEDIUM = 60, 30

# Grounding
MAX_CLAIMS, MIGRATE_OVERLAP, CHARS_PER_TOKEN = 40, 0.5, 3
EVIDENCE_LINES, EVIDENCE_SYMBOLS, KEY_FILES, ASK_FILES, DOSSIER_NEIGHBOURS = 120, 25, 6, 20, 15
CAP_LINKS, CAP_SYMBOLS, CAP_DANGLING, CAP_TESTED = 30, 15, 12, 15
BATCH = 8

# Scan
MAX_BYTES, MAX_SCAN_FILES = 1 << 20, 20_000
READ_LINES = 2000
ENRICH_MARKER = "<!-- ui:enrich -->"

STOPWORDS = frozenset(
    "a about all an and any are as at be but by can could do does for from get had has have how i if in into is it its "
    "me my no not of on or our should so some that the their them then there these they this to use used using was we "
    "were what when where which while who why will with work works would you your".split()
)

SYNONYMS = (
    "auth authentication authn login signin signon sso session",
    "perm permission authz authorization acl role rbac",
    "db database storage persistence sql",
    "config configuration settings options preferences",
    "init initialize initialise setup bootstrap",
    "delete remove destroy drop",
    "fetch request http api",
    "error exception failure fault",
    "user account profile",
    "test spec unittest",
    "dir directory folder",
    "doc docs documentation readme",
    "util utility helper",
    "nav navigate navigation router routing route",
    "embed embedding vector semantic",
    "search find query lookup",
    "log logging logger",
    "message messaging notification notify",
)

LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "cs": "csharp", "php": "php", "rb": "ruby", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "swift": "swift",
    "scala": "scala", "sh": "shell", "lua": "lua", "sql": "sql", "md": "markdown", "mdx": "markdown", "rst": "rst", "txt": "text",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css",
}
DOC_LANGUAGES = ("markdown", "rst", "text")
CONFIG_LANGUAGES = ("json", "yaml", "toml")
ASSET_LANGUAGES = ("html", "css")
#: Rows of an encoder's vocabulary that are broadcast; links of a module graph up to which one task walks it.
VOCABULARY_PART, TASK_LINKS = 100_000, 250_000
