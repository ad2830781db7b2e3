"""Lists, tables and patterns that results depend on, stated as they are defined."""

# File extensions that count as code.
CODE_EXTENSIONS = [
    ".rs", ".toml", ".py", ".pyx", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".mod", ".java", ".kt", ".kts", ".c", ".h", ".cpp", ".hpp",
    ".cc", ".cxx", ".cs", ".rb", ".php", ".swift", ".scala", ".sh", ".bash", ".zsh", ".json", ".yaml", ".yml",
]

# Names of files that mark a code project; with a star, endings.
PROJECT_MARKERS = [
    "Cargo.toml", "Cargo.lock", "setup.py", "pyproject.toml", "requirements.txt", "Pipfile", "package.json", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "go.mod", "go.sum", "pom.xml", "build.gradle", "build.gradle.kts", "*.csproj", "*.sln", "Makefile", "CMakeLists.txt", ".gitignore",
    ".editorconfig",
]

# Extensions of files that are not read as text.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz",
    ".bz2", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".bin", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".ttf", ".otf", ".woff", ".woff2", ".pyc",
    ".pyo", ".class", ".o", ".obj",
]

# Extensions and names of text files.
TEXT_FILES = [
    ".txt", ".md", ".rst", ".json", ".yaml", ".yml", ".toml", ".py", ".rs", ".js", ".ts", ".jsx", ".tsx", ".vue", ".svelte", ".html", ".htm", ".css", ".scss",
    ".sass", ".less", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".java", ".kt", ".scala", ".clj", ".go", ".rb", ".php", ".pl", ".pm", ".sh", ".bash", ".zsh",
    ".fish", ".sql", ".graphql", ".proto", ".xml", ".svg", ".csv", ".tsv", ".gitignore", ".dockerignore", ".env", ".cfg", ".ini", ".conf", ".config",
    "Makefile", "Dockerfile", "Vagrantfile", ".lock", ".sum",
]

# Programming language by extension.
LANGUAGES = {
    ".rs": "rust", ".py": "python", ".pyx": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".java": "java", ".kt": "kotlin", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}

# Text format by extension.
FORMATS = {
    ".md": "markdown", ".markdown": "markdown", ".rst": "restructuredtext", ".txt": "text", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".xml": "xml", ".html": "html", ".htm": "html", ".csv": "csv", ".log": "log",
}

# Languages with a parser, by extension.
PARSED = {
    ".rs": "rust", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
}

# Chunk type of a symbol's kind, of an element's type.
KIND_TYPES = {
    "function": "function", "method": "function", "class": "class", "struct": "class", "enum": "class", "trait": "class", "interface": "class",
    "module": "module", "const": "variable", "variable": "variable",
}
ELEMENT_TYPES = {
    "paragraph": "paragraph", "section": "section", "heading": "heading", "config": "metadata", "text": "text",
}

# Directories that are not read, and those that the ingest walk leaves out.
SKIPPED_DIRECTORIES = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "target", "build", "dist", ".idea", ".vscode",
]
WALK_SKIPPED = [
    "target", "node_modules", "dist", "build", "__pycache__",
]

# What a text must contain, in lower case, for a type or role, in the order of precedence.
TYPE_MARKS = (
    ("function", ("def ", "fn ", "func ", "function ", "public static", "private static", "async def", "async fn")),
    ("class", ("class ", "struct ", "interface ", "enum ", "trait ")),
    ("import", ("import ", "from ", "use ", "require(", "#include", "using ")),
)
COMMENT_STARTS = ("//", "#", "/*", "'''", '"""')
ROLE_MARKS = (
    ("constructor", ("__init__", "new(", "constructor", "::new")),
    ("test", ("#[test]", "def test_", "@test", "it(", "describe(")),
    ("error_handling", ("try:", "catch", "except", "error", "panic!")),
    ("entry_point", ("fn main(", "def main(", "if __name__", "public static void main")),
)

# Patterns counted, in any case, for the estimate of cyclomatic complexity.
BRANCHES = (
    r"\bif\b", r"\belif\b", r"\belse\s+if\b", r"\bmatch\b", r"\bcase\b", r"\bwhen\b", r"\bfor\b", r"\bwhile\b", r"\bloop\b", r"\btry\b", r"\bcatch\b",
    r"\bexcept\b", r"\brescue\b", r"&&", r"\|\|", r"\band\b", r"\bor\b", r"\?[^:]",
)

# Those of them whose matches may share characters with another's.
SHARING_BRANCHES = (r"\belse\s+if\b", r"\?[^:]")

# Types with the full and with the lower base score.
HIGH_TYPES = ("function", "method", "class", "module", "variable")
SECOND_TYPES = ("import", "comment")

# USD for 10^6 tokens of input, cached input, output; None where there is no price.
PRICES = {
    "gpt-5.1": (1.25, 0.125, 10.00),
    "gpt-5": (1.25, 0.125, 10.00),
    "gpt-5-mini": (0.25, 0.025, 2.00),
    "gpt-5-nano": (0.05, 0.005, 0.40),
    "gpt-5.1-chat-latest": (1.25, 0.125, 10.00),
    "gpt-5-chat-latest": (1.25, 0.125, 10.00),
    "gpt-5.1-codex": (1.25, 0.125, 10.00),
    "gpt-5-codex": (1.25, 0.125, 10.00),
    "gpt-5-pro": (15.00, None, 120.00),
    "gpt-4.1": (2.00, 0.50, 8.00),
    "gpt-4.1-mini": (0.40, 0.10, 1.60),
    "gpt-4.1-nano": (0.10, 0.025, 0.40),
    "gpt-4o": (2.50, 1.25, 10.00),
    "gpt-4o-2024-05-13": (5.00, None, 15.00),
    "gpt-4o-mini": (0.15, 0.075, 0.60),
    "gpt-realtime": (4.00, 0.40, 16.00),
    "gpt-realtime-mini": (0.60, 0.06, 2.40),
    "gpt-4o-realtime-preview": (5.00, 2.50, 20.00),
    "gpt-4o-mini-realtime-preview": (0.60, 0.30, 2.40),
    "gpt-audio": (2.50, None, 10.00),
    "gpt-audio-mini": (0.60, None, 2.40),
    "gpt-4o-audio-preview": (2.50, None, 10.00),
    "gpt-4o-mini-audio-preview": (0.15, None, 0.60),
    "o1": (15.00, 7.50, 60.00),
    "o1-pro": (150.00, None, 600.00),
    "o3-pro": (20.00, None, 80.00),
    "o3": (2.00, 0.50, 8.00),
    "o3-deep-research": (10.00, 2.50, 40.00),
    "o4-mini": (1.10, 0.275, 4.40),
    "o4-mini-deep-research": (2.00, 0.50, 8.00),
    "o3-mini": (1.10, 0.55, 4.40),
    "o1-mini": (1.10, 0.55, 4.40),
    "gpt-5.1-codex-mini": (0.25, 0.025, 2.00),
    "codex-mini-latest": (1.50, 0.375, 6.00),
    "gpt-5-search-api": (1.25, 0.125, 10.00),
    "gpt-4o-mini-search-preview": (0.15, None, 0.60),
    "gpt-4o-search-preview": (2.50, None, 10.00),
    "computer-use-preview": (3.00, None, 12.00),
    "gpt-image-1": (5.00, 1.25, None),
    "gpt-image-1-mini": (2.00, 0.20, None),
}

# Embedding models by preset, with their dimensions.
EMBEDDING_DIMS = {"fast": 384, "balanced": 768, "quality": 1024, "multilingual": 768, "code": 768}
