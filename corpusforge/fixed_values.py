"""Results are only right when these equal the published format.

Every word list, threshold, method name and marker below is part of the data
format or of the estimator's definition, so it is stated once, as plain text.
"""

# File types by lower-case suffix and by whole lower-case name.
FILE_TYPES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java",
    ".c": "c", ".h": "c_header", ".cpp": "cpp", ".hpp": "cpp_header",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".md": "markdown", ".txt": "text", ".json": "json", ".xml": "xml",
    ".html": "html", ".css": "css", ".sh": "shell", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml",
}
FILE_TYPES_BY_NAME = {"dockerfile": "dockerfile", "makefile": "makefile"}
DEFAULT_FILE_TYPE = "text"

# Token estimator, (characters per token, weight per keyword, keywords).
TOKEN_WORDS = {
    "python": (2.8, 0.7, "def class import from if elif else for while try except finally with as return yield "
                         "lambda and or not in is"),
    "javascript": (3.2, 0.8, "function const let var if else for while try catch finally return async await class "
                             "extends import export from"),
    "java": (2.5, 0.6, "public private protected static final class interface extends implements if else for while "
                       "try catch finally return new this super"),
    "c": (2.6, 0.5, "int char float double void if else for while do switch case break continue return struct "
                    "typedef include"),
    "cpp": (2.7, 0.6, "int char float double void bool auto const static inline virtual override final class struct "
                      "namespace template typename if else for while do switch case break continue return include "
                      "using public private protected try catch throw new delete this nullptr"),
    "c_header": (2.5, 0.5, "int char float double void const static extern typedef struct union enum include define "
                           "ifndef endif ifdef if else elif"),
    "cpp_header": (2.6, 0.6, "int char float double void bool auto const static inline virtual template typename "
                             "class struct namespace include define ifndef endif ifdef if else elif public private "
                             "protected"),
    "go": (3.0, 0.7, "func var const type if else for range switch case break continue return go defer chan struct "
                     "interface package import"),
    "rust": (2.9, 0.6, "fn let mut const if else match for while loop break continue return struct enum impl trait "
                       "use mod pub"),
}
# Markdown counts markup instead of words, every other type counts all words.
MARKDOWN_RATIO, MARKDOWN_WEIGHT = 4.0, 1.0
MARKDOWN_MARKUP = r"#{1,6}SPACE+|```|`|\*\*|__|\[[^\n]*?\]|\([^\n]*?\)"
DEFAULT_RATIO, DEFAULT_WEIGHT = 3.0, 0.8

# Level names and their short forms.
LEVELS = {
    "0": "none", "none": "none", "1": "light", "light": "light", "2": "medium", "medium": "medium",
    "3": "aggressive", "aggressive": "aggressive", "4": "semantic", "semantic": "semantic",
    "s": "smart", "S": "smart", "smart": "smart",
}

# Method descriptions.
METHOD_BLANK = "skip (empty/whitespace)"
METHOD_NONE = "none (raw)"
METHOD_LIGHT = "light (whitespace norm.)"
METHOD_MEDIUM = "medium (comments/blanks removed)"
METHOD_SEMANTIC = "semantic-llm"

# Line-comment markers used by the medium level, and by the regex reduction.
HASH_COMMENT_TYPES = ["python", "shell"]
SLASH_COMMENT_TYPES = ["javascript", "java", "c", "cpp", "go", "rust"]
SLASH_STRIP_TYPES = ["javascript", "java", "c", "cpp", "csharp", "go", "rust"]
BLOCK_COMMENT_TYPES = ["javascript", "java"]
C_FAMILY = ["cpp", "c", "cpp_header", "c_header"]

# Line starts kept by the signature skeletons.
JS_STARTS = ["class ", "function ", "async function ", "import ", "export "]
JAVA_STARTS = ["public ", "private ", "protected ", "class ", "interface ", "import "]
C_STARTS = ["#include", "#define", "#ifndef", "#endif", "namespace ", "class ", "struct ", "template", "using ",
            "typedef "]
C_TYPE_WORDS = ["int ", "void ", "bool ", "auto ", "char ", "float ", "double "]

# Smart routing.
SMART_CODE_TYPES = ["python", "javascript", "typescript", "java", "c", "cpp", "go", "rust"]
SMART_SEMANTIC_MIN_BYTES = 256
SMART_SEMANTIC_MIN_RATIO = 1.2
SMART_CODE_TIERS = (10000, 1000)
SMART_OTHER_TIERS = (5000, 500)

# Archive document format.
VERSION_KEY = "pak_format_version"
FORMAT_VERSION = "4.2.0-refactored"
REQUIRED_ENTRY_KEYS = ["path", "content", "original_size_bytes", "compressed_size_bytes", "estimated_tokens",
                       "compression_method"]

# Edit-script directives and definition line starts.
DIRECTIVES = {"file": "FILE:", "section": "SECTION:", "find_method": "FIND_METHOD:",
              "until_exclude": "UNTIL_EXCLUDE:", "replace_with": "REPLACE_WITH:"}
PREAMBLE_SECTION = "GLOBAL_PREAMBLE"
DEFINITION_STARTS = ["def ", "async def ", "class "]

# Prompt and preview limits, request-log thresholds.
PROMPT_MAX_CHARS = 100000
PREVIEW_LINES, PREVIEW_CHARS = 2, 80
PREFIX_CHARS, OUTLINE_PREFIX_CHARS = 2000, 1000
REQUESTS_PER_MINUTE, REQUEST_WINDOW_SECONDS = 15, 60
RECENT_ERROR_SECONDS, RECENT_ERROR_KEPT = 300, 10
SERVER_ERRORS = [500, 502, 503, 504]

# Keys a model response must have, and the defaults of missing ones.
RESPONSE_KEYS = ["file_path", "file_type", "overall_purpose", "key_components", "core_logic_flow"]
COMPONENT_LIST_KEYS = ["imports_dependencies", "classes", "functions_methods"]
COMPONENT_TEXT_KEYS = ["data_structures", "configuration"]

# The tool labels inside trailer lines are placeholders of the same length as the format's usual ones, so sizes and token
# counts agree; operators that write one take it as a parameter.
STRUCTURE_LABEL = "code_outline.py"
OUTLINE_LABEL = "outlining.py"
SEMANTIC_LABEL = "semantic_parts.py"
