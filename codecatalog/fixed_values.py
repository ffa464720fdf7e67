"""Lists, tables and texts that results depend on."""

# File suffixes of each language.
EXTENSIONS = {
    "python": [".py"],
    "typescript": [".ts", ".tsx", ".js", ".jsx"],
    "java": [".java"],
    "go": [".go"],
    "rust": [".rs"],
    "csharp": [".cs"],
    "cpp": [".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"],
    "ruby": [".rb"],
    "kotlin": [".kt", ".kts"],
}

# Directory names left out of a corpus scan; an entry with * is a glob.
DEFAULT_EXCLUDES = [
    "__pycache__",
    ".venv",
    "venv",
    ".git",
    "node_modules",
    ".tox",
    ".mypy_cache",
    ".pytest_cache",
    "dist",
    "build",
    "*.egg-info",
]

# Escapes in the order they must be applied.
HTML_ENTITIES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&#34;"),
    ("'", "&#39;"),
]

CONTENT_TYPES = {
    ".html": "text/html",
    ".htm": "text/html",
    ".md": "text/markdown",
    ".json": "application/json",
    ".css": "text/css",
    ".js": "text/javascript",
    ".txt": "text/plain",
    ".xml": "text/xml",
    ".svg": "image/svg+xml",
    ".png": "image/png",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Length limits, in characters.
SIGNATURE_LIMIT = 200
BODY_LIMIT = 1500
GENERIC_SOURCE_LIMIT = 6000
PREVIEW_LIMIT = 120

# Suffix, language name, comment form and comment style for the whole-file documentation prompt.
PROMPT_LANGUAGES = [
    (".py", "Python", '"""docstring"""', "docstring"),
    (".java", "Java", "/** Javadoc */", "javadoc"),
    (".ts", "TypeScript", "/** JSDoc */", "jsdoc"),
    (".tsx", "TypeScript", "/** JSDoc */", "jsdoc"),
    (".js", "JavaScript", "/** JSDoc */", "jsdoc"),
    (".jsx", "JavaScript", "/** JSDoc */", "jsdoc"),
    (".go", "Go", "// GoDoc", "godoc"),
    (".rs", "Rust", "/// rustdoc", "rustdoc"),
    (".cs", "C#", "/// XML doc", "xmldoc"),
    (".c", "C", "/** Doxygen */", "doxygen"),
    (".cpp", "C++", "/** Doxygen */", "doxygen"),
    (".cc", "C++", "/** Doxygen */", "doxygen"),
    (".cxx", "C++", "/** Doxygen */", "doxygen"),
    (".h", "C/C++", "/** Doxygen */", "doxygen"),
    (".hpp", "C++", "/** Doxygen */", "doxygen"),
    (".hxx", "C++", "/** Doxygen */", "doxygen"),
    (".rb", "Ruby", "# RDoc", "rdoc"),
    (".kt", "Kotlin", "/** KDoc */", "kdoc"),
    (".kts", "Kotlin", "/** KDoc */", "kdoc"),
]

# Instruction text for each docstring style.
DEFAULT_STYLE = "google"
STYLE_GUIDES = {
    "google": "Write a Google-style Python docstring. Include:\n"
    "- A one-line summary\n"
    "- Args section with type descriptions\n"
    "- Returns section describing the return value\n"
    "- Raises section if exceptions are raised\n",
    "numpy": "Write a NumPy-style Python docstring. Include:\n"
    "- A one-line summary\n"
    "- Parameters section with type\n"
    "- Returns section\n",
    "sphinx": "Write a Sphinx-style Python docstring. Include:\n"
    "- A one-line summary\n"
    "- :param name: description lines\n"
    "- :returns: description\n"
    "- :raises ExcType: description (if applicable)\n",
}

# System texts of the two prompt forms.
DOCSTRING_SYSTEM_TEXT = (
    "You are a documentation expert. "
    "Given a function or class signature and its source body, "
    "write a clear, accurate, and concise docstring. "
    "Return ONLY the docstring text (no triple quotes, no code fences). "
    "Do not explain your reasoning."
)
GENERIC_SYSTEM_TEXT = (
    "You are an expert code documentation writer. "
    "Given source code in {language}, add missing documentation comments "
    "to all public functions, methods, classes, and types that lack them. "
    "Use the {style} comment style ({comment}). "
    "Return the COMPLETE modified source code with documentation added. "
    "Do NOT remove any existing code or comments. "
    "Do NOT wrap the output in code fences. "
    "Do NOT add any explanation."
)

# How an added line is recognised as documentation, and the bare marks that do not count.
DOC_LINE_PATTERN = r'^(?:/\*\*|///|//!|// |#|"""|\*)'
BARE_DOC_MARKS = ["*", "*/", "/**", '"""']

# Words that look like a call or a declaration but name no symbol.
CONTROL_WORDS = ["if", "for", "while", "switch", "return", "sizeof", "typedef", "get", "set"]
NOT_A_TYPE = ["return", "else", "new", "throw"]
