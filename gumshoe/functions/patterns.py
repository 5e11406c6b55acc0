"""Regular-expression pieces and word lists shared by the operators.

Character classes are spelled out so that one pattern means the same thing in
the JVM regex engine and in RE2: a word character is any letter, number or
underscore, and white space is the full Unicode set.
"""

W = r"[\w\p{L}\p{N}]"
D = r"\p{Nd}"
S = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# A word can only start where no word character precedes it. Anchoring the
# first word of a pattern this way keeps a search linear on long words.
WORD = rf"(?<!{W})({W}+)"

WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RARE_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

NUMBER = (
    r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
)

# ---- fixed values: declarations in javascript / typescript ------------------------------
JS_FUNCTION = rf"^(?:export{S}+)?(?:async{S}+)?function{S}+({W}+){S}*\(([^)]*)\)"
JS_ASSIGNED = rf"^(?:const|let|var){S}+({W}+){S}*={S}*(?:async{S}+)?\(([^)]*)\)"
JS_VARIABLE = rf"^(?:const|let|var){S}+({W}+)"
JS_LOOP_VARIABLE = rf"^for{S}*\({S}*(?:let|var|const){S}+({W}+)"

# The same declarations searched in a whole text whose line breaks are "\n".
B = r"[\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
JS_HEADERS = (
    rf"(?dm)^{B}*(?:(?:export{B}+)?(?:async{B}+)?function{B}+{W}+{B}*\([^)\n]*\)"
    rf"|(?:const|let|var){B}+{W}+{B}*={B}*(?:async{B}+)?\([^)\n]*\))"
)
JS_HEADER_NAME = rf"(?:function|const|let|var){B}+({W}+)"
JS_HEADER_PARAMS = r"\(([^)]*)\)"
JS_VARIABLES = rf"(?dm)^{B}*(?:const|let|var){B}+({W}+)"
JS_LOOP_VARIABLES = rf"(?dm)^{B}*for{B}*\({B}*(?:let|var|const){B}+({W}+)"

JS_CLASS = rf"^(?:export{S}+)?class{S}+({W}+)"
JS_LOOP = rf"^(?:for|while){S}*\("
JS_CONDITIONAL = rf"^if{S}*\("
JS_CALL = rf"{WORD}{S}*\("
JS_DECLARATION_START = rf"^(?:const|let|var|function|class|import|export|return){S}"

# ---- fixed values: what the line rules search for ------------------------------------------------------------
OFF_BY_ONE = rf"{WORD}{S}*<={S}*({W}+)\.length"
INDEX_PLUS = rf"{WORD}\[({W}+){S}*\+{S}*({D}+)\]"
INDEX_PLUS_GUARD = r"if|while|&&|\|\||\.length"
MEMBER = rf"{WORD}\.({W}+)"
DIVISION = rf"{WORD}{S}*/{S}*({W}[\w\p{{L}}\p{{N}}.]*)"
NULL_CALL = rf"{WORD}\({S}*null{S}*\)"
IDENTIFIER = rf"(?<!{W})[a-zA-Z_]{W}*"
# The first "def" is as good as any later one, so it is fixed; that keeps the search linear.
MUTABLE_DEFAULT = rf"\A(?>.*?def{S}+{W}+\().*?={S}*(?:\[\]|\{{\}}|\(\))"
INDEX_ANY = rf"{W}\[{D}+\]"
INDEX_LARGE = rf"{W}\[-?{D}{{2,}}\]"
INDEX_GUARD = r"if|while|for|len"
BARE_EXCEPT = rf"except{S}*:"
TYPED_EXCEPT = rf"except{S}+{W}"
SECRET_PY = rf"(?iu)(?:password|secret|api_key|token){S}*={S}*[\"'][^\"']+[\"']"
SECRET_JS = rf"(?iu)(?:password|secret|api_key|token){S}*[:=]{S}*[\"'][^\"']+[\"']"
LOOSE_EQUALITY = r"[^=!]==[^=]"

# ---- fixed values: names every javascript file may use ---------------------
JS_BUILTINS = [
    "console", "Math", "JSON", "Object", "Array", "String", "Number",
    "Boolean", "Date", "RegExp", "Error", "Map", "Set", "Promise",
    "parseInt", "parseFloat", "isNaN", "isFinite", "undefined", "null",
    "true", "false", "NaN", "Infinity", "window", "document",
    "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "require", "module", "exports", "process", "global", "__dirname",
]

# ---- fixed values: objects whose members are never flagged as null ---------
JS_SAFE_OBJECTS = [
    "console", "Math", "JSON", "Object", "Array", "String", "Number",
    "Date", "document", "window", "process", "module", "result", "this",
]

# ---- fixed values: javascript keywords and common member names -------------
JS_KEYWORDS = [
    "if", "else", "for", "while", "do", "switch", "case", "break",
    "continue", "return", "function", "class", "const", "let", "var", "new",
    "typeof", "instanceof", "in", "of", "this", "super", "yield", "await",
    "async", "try", "catch", "finally", "throw", "import", "export",
    "default", "from", "as", "void", "delete", "with", "toUpperCase",
    "toLowerCase", "toString", "valueOf", "push", "pop", "shift", "unshift",
    "splice", "slice", "map", "filter", "reduce", "forEach", "find", "some",
    "every", "includes", "indexOf", "join", "split", "trim", "length", "log",
    "error", "warn", "info",
]

# ---- fixed values: words before "(" that are not calls ---------------------
JS_NOT_CALLS = ["if", "for", "while", "switch", "function", "return"]

# ---- fixed values: a guard line names the object and holds one of these ----
JS_GUARD_MARKS = ["if", "?", "!", "&&", "||", "null", "undefined"]

# ---- fixed values: names every python file may use -------------------------
PY_BUILTINS = [
    "print", "len", "range", "int", "float", "str", "list", "dict", "set",
    "tuple", "bool", "type", "input", "open", "file", "map", "filter", "zip",
    "enumerate", "sorted", "reversed", "sum", "min", "max", "abs", "round",
    "pow", "isinstance", "issubclass", "hasattr", "getattr", "setattr",
    "delattr", "super", "property", "staticmethod", "classmethod", "True",
    "False", "None", "Exception", "ValueError", "TypeError", "KeyError",
    "IndexError", "AttributeError", "RuntimeError", "StopIteration",
    "NotImplementedError", "OSError", "IOError", "FileNotFoundError",
    "ImportError", "ModuleNotFoundError", "__name__", "__main__", "__file__",
    "__doc__", "self", "cls",
]

# ---- fixed values: language names accepted as declared ---------------------
LANGUAGES = [
    "python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go",
    "rust", "ruby", "php", "html", "css", "sql",
]

# ---- fixed values: file suffix to language ---------------------------------
SUFFIX_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".csv": "csv",
    ".png": "image", ".jpg": "image", ".jpeg": "image",
}
CODE_SUFFIXES = [".py", ".js", ".ts"]
TABLE_SUFFIXES = [".csv"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg"]
ALLOWED_SUFFIXES = CODE_SUFFIXES + IMAGE_SUFFIXES + TABLE_SUFFIXES

# ---- fixed values: markers counted by the language score -------------------
PY_MARKS = ["def ", "import ", "from ", "print(", "elif ", "    "]
JS_MARKS = ["function ", "const ", "let ", "var ", "=>", "console.log", "require(", "module.exports"]
TS_LOWER_MARKS = [": string", ": number", ": boolean"]
TS_MARKS = ["interface "]

# ---- fixed values: typographic characters and their plain spelling ---------
PLAIN_SPELLING = [
    ("\u2014", "--"), ("\u201c", '"'), ("\u201d", '"'), ("\u2018", "'"),
    ("\u2019", "'"), ("\u2026", "..."), ("\u00a0", " "),
]

# ---- fixed values: csv tokens read as null ---------------------------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
