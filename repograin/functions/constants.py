"""Fixed values. They decide results, so they are stated as plain data."""

# File extension -> grammar language (case-sensitive).
# ``.jsx`` takes the typescript rules: its component declarations need them.
EXT_LANG = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "typescript",
    ".c": "c",
    ".cpp": "c",
    ".cc": "c",
    ".h": "c",
    ".java": "java",
    ".md": "markdown",
    ".html": "html",
    ".htm": "html",
    ".json": "json",
    ".vue": "vue",
    ".ipynb": "python",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "c_sharp",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
    ".scala": "scala",
    ".sh": "bash",
    ".bash": "bash",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".toml": "toml",
    ".sql": "sql",
}

# Lower-cased extension -> language name shown to the summariser.
DISPLAY_LANGUAGE = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript (React)",
    ".c": "C",
    ".cpp": "C++",
    ".cc": "C++",
    ".h": "C/C++ Header",
    ".java": "Java",
    ".md": "Markdown",
    ".html": "HTML",
    ".json": "JSON",
}

# Extensions of the "supported files" listing.
SUPPORTED_EXTENSIONS = [
    ".py", ".js", ".ts", ".tsx", ".c", ".cpp", ".cc", ".h", ".java", ".md", ".html", ".htm", ".json",
]

# Short tags for symbol types; other types use their first three letters.
TYPE_TAGS = {
    "function": "fun",
    "class": "cla",
    "variable": "var",
    "interface": "int",
    "struct": "str",
    "trait": "trt",
    "method": "mtd",
    "component": "cmp",
    "table": "tbl",
    "key": "key",
    "tag": "tag",
    "heading": "hdr",
    "enum": "enu",
    "type": "typ",
    "module": "mod",
    "property": "prp",
    "attribute": "att",
}

# The library's own store folder; it is always hidden from scans.
STORE_DIR = ".repograin"

# Patterns every suggestion set is merged with.
DEFAULT_PATTERNS = [
    "*.pyc", "*.pyo", "*.pyd", "__pycache__/", ".git/", ".svn/", ".hg/", ".DS_Store", "*.log", "*.tmp",
    "*.temp", "node_modules/", "env/", "venv/", ".env/", "build/", "dist/", "*.egg-info/", ".pytest_cache/",
    ".tox/", ".coverage", "htmlcov/", ".idea/", ".vscode/", "*.swp", "*.swo", "*~", STORE_DIR + "/",
]

# Patterns of the component-wise ignore mode.
COMPONENT_PATTERNS = [
    ".git", ".nuxt", ".output", "node_modules", "__pycache__",
    "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dll", "*.class",
    "*.exe", "*.bin", "*.pkl", "*.h5", "*.model", "*.jpg", "*.jpeg",
    "*.png", "*.gif", "*.svg", "*.ico", "*.pdf", "*.zip", "*.tar.gz",
    "*.mp3", "*.mp4", "*.avi", "*.mov", "*.wav", "*.flac", "*.lock",
]

# Names of temporary and build-hash files, as regular expressions on one path component.
COMPONENT_NAME_REGEXES = [r"\.[0-9]+", r"\.[A-Za-z0-9]{5,}"]

# Folders and files of the name-set ignore mode.
NAME_SET_FOLDERS = [
    ".git", ".svn", ".hg", "node_modules", "venv", "env", "__pycache__", ".pytest_cache",
    "build", "dist", "out", "target", ".vscode", ".idea", ".Trash", "$Recycle.Bin",
]
NAME_SET_FILES = [
    ".DS_Store", "Thumbs.db", "*.tmp", "*.temp",
    ".gitignore", ".editorconfig", ".env", "*.log",
    "*.swp", "*.swo", "*~", ".*.swp",
    ".vscode", ".idea", "*.sublime-*",
    "desktop.ini", ".directory",
]

# Limits and estimates.
LARGE_REPO_FILES = 1000
LARGE_REPO_MIB = 50
MAX_FILE_MIB = 10
CHARS_PER_TOKEN = 4
COST_PER_REQUEST = 0.0005
SINGLE_MAX_CHARS = 80_000
BATCH_MAX_CHARS = 50_000
BATCH_MAX_REQUESTS = 50_000
BATCH_MAX_BYTES = 500 * 1024 * 1024
SYMBOLS_PER_LINE = 100
HISTORY_KEEP = 10
PREVIEW_CHARS = 80
