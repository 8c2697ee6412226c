"""Word lists, lookup tables, formats and source patterns.

Results depend on these being exactly as written, so they are kept in one
place, as plain text. Patterns are written in the ECMAScript dialect that
defines the extraction rules and are turned into Java patterns by
``functions.text.js``.
"""

# --- fixed values: whitespace as ECMAScript defines it ----------------------
JS_WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# --- fixed values: which paths count as source ------------------------------
SOURCE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "prisma", "sql"]
SCRIPT_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]
MARKUP_EXTENSIONS = ["tsx", "jsx"]
IGNORED_DIRECTORIES = [
    "node_modules", ".git", "dist", "build", ".next", "out", "coverage",
    ".aicontext", ".turbo", ".cache", ".vercel",
]
STATE_DIRECTORY = ".aicontext"
IGNORED_NAME_PATTERNS = [
    r"[^/]*\.min\.[^/]*", r"[^/]*\.d\.ts", r"[^/]*\.map",
    r"package-lock\.json", r"pnpm-lock\.yaml", r"yarn\.lock", r"bun\.lockb",
]
WATCH_NOISE = ["node_modules", ".aicontext", ".git"]

# --- fixed values: languages, stacks, built-in modules ----------------------
LANGUAGE_BY_EXTENSION = {
    "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx",
    "mjs": "js", "cjs": "js", "prisma": "prisma", "sql": "sql",
}
STACK_BY_DEPENDENCY = {
    "next": "nextjs",
    "express": "express",
    "react": "react",
    "react-dom": "react",
    "@prisma/client": "prisma",
    "prisma": "prisma",
    "mongoose": "mongoose",
    "@supabase/supabase-js": "supabase",
}
STACK_NAMES = ["express", "mongoose", "nextjs", "prisma", "react", "supabase"]
STACK_MARKER_FILES = {
    "prisma": ["prisma/schema.prisma"],
    "nextjs": ["next.config.js", "next.config.mjs", "next.config.ts"],
}
STACK_MARKER_DIRECTORIES = {"supabase": "supabase"}
RUNTIME_MODULES = [
    "fs", "path", "os", "crypto", "http", "https", "url", "util", "events",
    "stream", "child_process", "process", "buffer", "zlib", "net", "assert",
]
IMPORT_CAP = 15
HTTP_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]

# --- fixed values: budgets, boards, defaults --------------------------------
CHARS_PER_TOKEN = 4
DEFAULT_BUDGET = 2000
DEFAULT_DECISIONS = 5
DEFAULT_PROJECT_NAME = "project"
DEFAULT_AGENT = "unknown"
SNAPSHOT_VERSION = 1
TASK_STATUSES = ["open", "claimed", "in-progress", "blocked", "done"]
LISTED_EXPORTS = 6
LISTED_TASKS = 10
HANDOFF_PREVIEW_LINES = 6
OUTLINE_CHARS = 120
TITLE_LIMIT = 60
TITLE_CUT = 57
BOARD_HEAD = "# Tasks\n\nGenerated from tasks.json — do not hand-edit."
SECTION_PRIORITIES = {
    "state": 1, "handoff": 2, "tasks": 3, "plan": 4, "decisions": 5,
    "map-head": 6, "routes": 7, "db": 8, "components": 9, "files": 10,
}
ENGINE_ORDER = ["postgres", "prisma", "mongo"]
FRESHNESS_ROOTS = ["src", "app", "pages", "lib"]
DEBOUNCE = "250 milliseconds"

# --- fixed values: source patterns ------------------------------------------
IDENTIFIER = r"[A-Za-z_$][\w$]*"

IMPORT_FROM = r"""import\s+(?:[^'"]*?\s+from\s+)?["']([^"']+)["']"""
REQUIRE_CALL = r"""require\(\s*["']([^"']+)["']\s*\)"""
EXPORT_FROM = r"""export\s+(?:\*|\{[^}]*\})\s+from\s+["']([^"']+)["']"""

EXPORT_DECLARATION = (
    r"export\s+(?:async\s+)?(function\*?|class|const|let|var|type|interface|enum)"
    r"\s+([A-Za-z_$][\w$]*)"
)
EXPORT_DEFAULT = r"export\s+default\s+(?:(function\*?|class)\s+)?([A-Za-z_$][\w$]*)?"
EXPORT_BRACES = r"export\s*\{([^}]*)\}"
BRACE_ALIAS = r"(?:\w+)\s+as\s+([A-Za-z_$][\w$]*)"
BRACE_ALIAS_TAIL = r"\s+as\s+.*"
COMMONJS_ASSIGN = r"module\.exports\s*=\s*(?:(function\*?|class)\s+)?([A-Za-z_$][\w$]*)?"
COMMONJS_OBJECT = r"module\.exports\s*=\s*\{([^}]*)\}"
COMMONJS_PROPERTY = r"(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*="

EXPORTED_VERB = (
    r"export\s+(?:async\s+)?(?:function|const)\s+"
    r"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
)
CALL_ROUTE = (
    r"""\b([A-Za-z_$][\w$]*)\.(get|post|put|patch|delete|head|options|all)"""
    r"""\s*\(\s*(["'`])([^"'`]+)\3"""
)
CALL_VERB = r"\.(get|post|put|patch|delete|head|options|all)\s*\("
MOUNT_CALL = r"""\.use\s*\(\s*(["'`])(\/[^"'`]*)\1\s*,"""

MARKUP_TAG = r"<[A-Za-z]"
MARKUP_RETURN = r"return\s*\("
FUNCTION_COMPONENT = r"(?:export\s+)?(?:default\s+)?function\s+([A-Z][\w$]*)\s*\(([^)]*)\)"
ARROW_COMPONENT = (
    r"(?:export\s+)?const\s+([A-Z][\w$]*)\s*(?::[^=]+)?=\s*"
    r"(?:\([^)]*\)|[A-Za-z_$][\w$]*)?\s*(?:\(([^)]*)\))?\s*(?::[^=]+)?=>"
)
HOOK_CALL = r"\b(use[A-Z][\w$]*)\s*\("
LEADING_BRACES = r"^\{([^}]*)\}"

MODEL_BLOCK = r"model\s+([A-Za-z_][\w]*)\s*\{([^}]*)\}"
MODEL_FIELD = r"^([A-Za-z_][\w]*)\s+\S+"
CREATE_TABLE = (
    r"""(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?["'`]?([\w.]+)["'`]?\s*\("""
)
TABLE_CONSTRAINT = r"(?i)^(primary|foreign|unique|constraint|check|key|index)\b"
COLUMN_NAME = r"""^["'`]?([A-Za-z_][\w]*)["'`]?"""
TYPES_BLOCK = r"Tables\s*:\s*\{"
TYPES_TABLE = r"([A-Za-z_][\w]*)\s*:\s*\{\s*Row\s*:\s*\{([^}]*)\}"
TYPES_COLUMN = r"([A-Za-z_][\w]*)\s*:"
TYPES_PATH = r"(?i)database\.types\.ts\z|supabase.*types.*\.ts\z"
NEW_SCHEMA = r"new\s+(?:mongoose\.)?Schema\s*(?:<[^>]*>)?\s*\(\s*\{"
MODEL_CALL = r"""model\s*(?:<[^>]*>)?\s*\(\s*["'`]([A-Za-z_][\w]*)["'`]"""
SCHEMA_VARIABLE = r"const\s+([A-Za-z_][\w]*)\s*=\s*new\s+(?:mongoose\.)?Schema"
SCHEMA_FIELD = r"""^["'`]?([A-Za-z_$][\w$]*)["'`]?\s*:"""
DEFAULT_COLLECTION = "Collection"

WEB_ROOTS = r"^(app|src\/app|pages|src\/pages)\/"
ROUTE_FILE = r"(^|\/)route\.(tsx?|jsx?)\z"
PAGE_FILE = r"(^|\/)page\.(tsx?|jsx?)\z"

HEADING = r"^#{1,3}\s"
DECISION_BREAK = r"\n(?=##\s)"
ANSWER_FENCE_START = r"(?i)^```(?:json)?\s*"
ANSWER_FENCE_END = r"```\s*\z"
