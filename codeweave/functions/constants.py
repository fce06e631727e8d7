"""Fixed values that results depend on.

FIXED VALUES -- these must stay exactly as listed for results to match the
behaviour being reproduced (directory names, extensions, language names,
framework names, sentinels, batch sizes).  They are data, kept together here.
"""

# FIXED VALUES: directories skipped during source discovery
IGNORE_DIRS_DISCOVERY = [
    ".git", "node_modules", "venv", "__pycache__", ".idea", ".vscode",
    "dist", "build", ".next", ".pytest_cache",
]

# FIXED VALUES: directories skipped when counting languages / finding config files
IGNORE_DIRS_PROJECT = [
    ".git", "node_modules", "venv", "__pycache__", ".idea", ".vscode",
    "dist", "build", ".next",
]

# FIXED VALUES: discoverable source suffixes (case-sensitive)
SUPPORTED_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".h", ".hpp", ".cs",
]

# FIXED VALUES: lower-cased suffix -> language
LANGUAGE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".h": "C/C++",
    ".hpp": "C++",
    ".c": "C",
    ".java": "Java",
    ".go": "Go",
    ".rs": "Rust",
    ".php": "PHP",
    ".rb": "Ruby",
    ".cs": "C#",
    ".kt": "Kotlin",
    ".swift": "Swift",
}

# FIXED VALUES: languages with an entity extractor
ANALYZABLE_LANGUAGES = ["Python", "JavaScript", "C++", "Java"]

# FIXED VALUES: file names that make a directory importable as a package
PACKAGE_INDEX_FILES = ["__init__.py", "index.js", "index.jsx", "index.ts", "index.tsx"]

# FIXED VALUES: sentinels and labels
EXTERNAL_FILE = "external"
NO_SUMMARY = "No summary available."
TRUNCATION_MARKER = "\n\n... [CODE TRUNCATED] ...\n\n"

# FIXED VALUES: batch sizes and budgets
SUMMARY_BATCH_SIZE = 10
EMBEDDING_BATCH_SIZE = 20
EMBEDDING_DIM = 768
TOP_K_DEFAULT = 5
TOP_K_MIN = 1
TOP_K_MAX = 20
ARCHITECTURE_EDGE_LIMIT = 15
TRUNCATE_HEAD_LINES = 60
TRUNCATE_TAIL_LINES = 30

# FIXED VALUES: question types
QUESTION_TYPES = ["FUNCTION", "FILE", "ARCHITECTURE", "PROJECT_OVERVIEW", "SEMANTIC_SEARCH"]
