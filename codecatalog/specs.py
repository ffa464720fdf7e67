"""Language descriptions: data that the extraction job compiles into column expressions.

A declaration pattern is matched against a logical line whose comments and string contents are
blanked (strings with \\x01), so a bracket or keyword inside a literal never counts. Group numbers name the parts. Text
that may hold literals (parameters, return types) is cut from the unblanked line at the same offsets,
for which ``head`` (everything before the parameters) and ``mid`` (between parameters and return
type) are captured too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from codecatalog import fixed_values as fv
from codecatalog import lexers
from codecatalog.lexers import Lexer

# Patterns see brackets within brackets replaced (``functions.folds.flat_brackets``), so one level is all they name.
PARAMS = r"([^()]*+)"
BRACES = r"\{[^{}]*+\}"
GENERICS = r"(?:\s*<[^()]*>)?"
TYPE_GENERICS = r"(?:\s*<[^{(]*?>(?=[\s{:(;]|$))?"
ANNOTATIONS = r"(?:@[\w.]+(?:\([^()]*\))?\s+)*+"
# A return type. A brace belongs to it where an operator or a type word stands before it, else it opens the body.
RETURNS = rf"((?:[^{{}};]++|(?<=[:|&<,(\[]\s{{0,4}}){BRACES})*+)"
GO_RETURNS = rf"((?:[^{{}};]++|(?<=\b(?:interface|struct)\s{{0,4}}){BRACES})*+)"

DOUBLE_QUOTED = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
SINGLE_QUOTED = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
BACKTICKS = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
TEXT_BLOCK = r'"""[\s\S]*?"""'
SLASH_COMMENTS = r"//[^\n]*|/\*(?>[^*]*)(?:\*(?!/)(?>[^*]*))*+\*/"


def starting(chars: str, literals: str) -> str:
    """Literals that begin with one of ``chars``: at other characters no alternative is tried."""
    return f"(?=[{chars}])(?:{literals})"


def _long_string(quotes: str) -> str:
    """Up to the first quotes without a backslash before them, or to the end; runs of other characters are taken at once."""
    end = rf"(?:(?<!\\){quotes}|$)"
    return rf"{quotes}(?:(?>[^{quotes[0]}\n\r\u0085\u2028\u2029]+)|(?!{end})[\s\S])*+{end}"


@dataclass(frozen=True)
class Decl:
    """One declaration form of a language."""

    kind: str  # 'class', 'function' or 'scope'
    pattern: str
    where: str = "top"  # 'top', 'member' or 'any'
    marker: str = ""
    name: int = 1
    head: int = 0
    params: int = 0
    mid: int = 0
    ret: int = 0
    bases: int = 0
    implements: int = 0
    base_params: bool = False
    receiver: int = 0
    mods: int = 0
    accepts: tuple[str, ...] = ()  # for scopes: 'transparent' or 'impl'


@dataclass(frozen=True)
class LangSpec:
    name: str
    extensions: tuple[str, ...]
    literals: str  # comments and strings
    comment: str  # start of a comment literal
    decls: tuple[Decl, ...]
    directive: str = ""  # start of a line that is blanked like a comment, but that a compiler reads
    lexer: Lexer | None = None  # for files whose literals may nest
    scope: str = "brace"  # 'brace', 'indent' or 'end'
    doc_style: str = "block"  # 'block', 'line', 'xml' or 'string'
    doc_block: str = ""
    doc_line: str = ""
    annotation: str = r"^\s*(?:@[\w.]+\s*(?:\([^()]*+(?:\)|$))?\s*)++$"
    package: str = ""
    param_style: str = "name_first_colon"
    angle_brackets: bool = True
    quote_chars: bool = False  # 'x' is a character, not a string
    skip_names: tuple[str, ...] = ()
    skip_returns: tuple[str, ...] = ()
    skip_caps_functions: bool = False
    exported_only: bool = False
    skip_path_suffix: str = ""
    memberless: tuple[str, ...] = ()  # markers whose bodies carry no methods
    owner_marker: str = ""  # methods join their receiver type of this marker
    nested_types: bool = True
    module_doc: str = ""
    module_doc_within: int = 0  # the module doc must start before this offset
    tag_marks: str = "@"


_JVM_TYPES = r"[\w.<>,\[\]? &]+?"
_ACCESS = r"(?:public|private|protected|internal)"

PYTHON = LangSpec(
    name="python",
    extensions=tuple(fv.EXTENSIONS["python"]),
    lexer=lexers.PYTHON,
    literals=starting(
        "\"'#", _long_string('"""') + "|" + _long_string("'''") + "|" + DOUBLE_QUOTED + "|" + SINGLE_QUOTED + r"|#[^\n]*"
    ),
    comment=r"^#",
    scope="indent",
    doc_style="string",
    param_style="python",
    angle_brackets=False,
    nested_types=False,
    decls=(
        Decl(
            "function",
            rf"^(\s*((?:async\s+)?)def\s+(\w+)\s*(?:\[[^\]]*\])?\s*\(){PARAMS}(\)\s*(?:->\s*)?)([^:]*?)\s*:",
            where="any", head=1, mods=2, name=3, params=4, mid=5, ret=6,
        ),
        Decl(
            "class",
            rf"^(\s*class\s+(\w+)\s*(?:\[[^\]]*\])?\s*\(){PARAMS}\)\s*:",
            head=1, name=2, params=3, base_params=True,
        ),
        Decl("class", r"^\s*class\s+(\w+)\s*(?:\[[^\]]*\])?\s*:"),
    ),
)

_TS_MODS = r"(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set)"
TYPESCRIPT = LangSpec(
    name="typescript",
    extensions=tuple(fv.EXTENSIONS["typescript"]),
    lexer=lexers.TYPESCRIPT,
    literals=starting(
        "/\"'`",
        SLASH_COMMENTS + "|" + DOUBLE_QUOTED + "|" + SINGLE_QUOTED + "|" + BACKTICKS
        + r"|(?<=[=(,:;!&|?{}\[]\s?|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await)\s{0,4})/(?![/*\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*"
    ),
    comment=r"^/[/*]",
    doc_block=r"^\s*/\*\*",
    param_style="typescript",
    skip_names=tuple(fv.CONTROL_WORDS) + ("catch", "function", "super"),
    memberless=("interface",),
    module_doc=r"/\*\*([\s\S]*?)\*/",
    module_doc_within=50,
    decls=(
        Decl(
            "function",
            rf"^(\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?((?:async\s+)?)function\s*\*?\s*(\w+){GENERICS}\s*\()"
            rf"{PARAMS}(\)\s*(?::\s*)?){RETURNS}\s*(?:\{{|;|$)",
            head=1, mods=2, name=3, params=4, mid=5, ret=6,
        ),
        Decl(
            "function",
            rf"^(\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::.+?)?\s*=\s*((?:async\s*)?){GENERICS}\s*\()"
            rf"{PARAMS}(\)\s*(?::\s*)?)(.*?)\s*=>",
            head=1, name=2, mods=3, params=4, mid=5, ret=6,
        ),
        Decl(
            "class",
            rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(\w+){TYPE_GENERICS}"
            r"(?:\s+extends\s+(.*?))?(?:\s+implements\s+(.*?))?\s*(?:\{|$)",
            bases=2, implements=3,
        ),
        Decl(
            "class",
            rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(\w+){TYPE_GENERICS}"
            r"(?:\s+extends\s+(.*?))?\s*(?:\{|$)",
            marker="interface", bases=2,
        ),
        Decl(
            "function",
            rf"^(\s*{ANNOTATIONS}((?:{_TS_MODS}\s+(?=[\w$#*\[\x01]))*+)\*?\s*([\w$#]+)\??{GENERICS}\s*\()"
            rf"{PARAMS}(\)\s*(?::\s*)?){RETURNS}\s*(?:\{{|;|$)",
            where="member", head=1, mods=2, name=3, params=4, mid=5, ret=6,
        ),
        Decl(
            "scope", r"^\s*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w.]+)\s*(?:\{|$)",
            accepts=("transparent",),
        ),
    ),
)

_JAVA_TYPE_MODS = r"(?:(?:public|private|protected|abstract|final|static|sealed|non-sealed|strictfp)\s+)*+"
_JAVA_MODS = (
    r"((?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|override)\s+)*+)"
)
JAVA = LangSpec(
    name="java",
    extensions=tuple(fv.EXTENSIONS["java"]),
    literals=starting("/\"'", SLASH_COMMENTS + "|" + TEXT_BLOCK + "|" + DOUBLE_QUOTED + "|" + CHAR),
    comment=r"^/[/*]",
    doc_block=r"^\s*/\*\*",
    package=r"^package\s+([\w.]+)\s*;",
    param_style="type_first_java",
    quote_chars=True,
    skip_names=tuple(fv.CONTROL_WORDS[:7]) + ("catch", "synchronized", "super", "this"),
    skip_returns=tuple(fv.NOT_A_TYPE),
    memberless=("interface", "enum"),
    decls=(
        Decl(
            "class",
            rf"^\s*{ANNOTATIONS}{_JAVA_TYPE_MODS}class\s+(\w+){TYPE_GENERICS}"
            r"(?:\s+extends\s+(.*?))?(?:\s+implements\s+(.*?))?(?:\s+permits\s[^{]*)?\s*(?:\{|$)",
            bases=2, implements=3,
        ),
        Decl(
            "class",
            rf"^\s*{ANNOTATIONS}{_JAVA_TYPE_MODS}interface\s+(\w+){TYPE_GENERICS}"
            r"(?:\s+extends\s+(.*?))?(?:\s+permits\s[^{]*)?\s*(?:\{|$)",
            marker="interface", bases=2,
        ),
        Decl(
            "class",
            rf"^\s*{ANNOTATIONS}{_JAVA_TYPE_MODS}enum\s+(\w+)(?:\s+implements\s+(.*?))?\s*(?:\{{|$)",
            marker="enum", bases=2,
        ),
        Decl(
            "function", rf"^(\s*{ANNOTATIONS}((?:public|private|protected)\s+)(\w+)\s*\(){PARAMS}\)",
            where="member", head=1, mods=2, name=3, params=4,
        ),
        Decl(
            "function",
            rf"^(\s*{ANNOTATIONS}{_JAVA_MODS}(?:<[^()]*?>\s+)?({_JVM_TYPES})\s+(\w+)\s*\(){PARAMS}\)",
            where="member", head=1, mods=2, ret=3, name=4, params=5,
        ),
    ),
)

GO = LangSpec(
    name="go",
    extensions=tuple(fv.EXTENSIONS["go"]),
    literals=starting("/\"'`", SLASH_COMMENTS + "|" + DOUBLE_QUOTED + "|" + CHAR + "|`[^`]*`"),
    comment=r"^/[/*]",
    doc_style="line",
    doc_line=r"^//",
    annotation="",
    package=r"^package\s+(\w+)",
    param_style="name_first_space",
    angle_brackets=False,
    quote_chars=True,
    exported_only=True,
    skip_path_suffix="_test.go",
    memberless=("interface", "struct"),
    owner_marker="struct",
    decls=(
        Decl("class", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", marker="struct"),
        Decl("class", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", marker="interface"),
        Decl(
            "function",
            rf"^(func\s+(\w+)(?:\[[^\]]*\])?\s*\(){PARAMS}(\)\s*){GO_RETURNS}\s*\{{",
            head=1, name=2, params=3, mid=4, ret=5,
        ),
        Decl(
            "function",
            r"^(func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*(\w+)\s*\()"
            rf"{PARAMS}(\)\s*){GO_RETURNS}\s*\{{",
            head=1, receiver=2, name=3, params=4, mid=5, ret=6,
        ),
    ),
)

_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
RUST = LangSpec(
    name="rust",
    extensions=tuple(fv.EXTENSIONS["rust"]),
    lexer=lexers.RUST,
    literals=starting("/r\"'", SLASH_COMMENTS + r'|r#"[\s\S]*?"#|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|' + CHAR),
    comment=r"^/[/*]",
    doc_style="line",
    doc_line=r"^\s*///(?!/)",
    annotation=r"^\s*#!?\[.*\]\s*$",
    param_style="rust",
    quote_chars=True,
    memberless=("struct", "enum", "trait"),
    owner_marker="struct",
    module_doc=r"(?m)((?:^[ \t]*//![^\n]*\n?)++)",
    module_doc_within=100,
    decls=(
        Decl("class", rf"^\s*{_PUB}struct\s+(\w+)", marker="struct"),
        Decl("class", rf"^\s*{_PUB}enum\s+(\w+)", marker="enum"),
        Decl("class", rf"^\s*{_PUB}(?:unsafe\s+)?trait\s+(\w+)", marker="trait"),
        Decl(
            "scope",
            r"^\s*(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:[^{]+?\s+for\s+)?&?(?:\w+::)*(\w+)[^{]*(?:\{|$)",
            accepts=("impl",),
        ),
        Decl(
            "function",
            rf"^(\s*{_PUB}((?:(?:default|const|async|unsafe)\s+)*+)(?:extern\s+(?:\x01+\s*)?)?fn\s+(\w+){GENERICS}\s*\()"
            rf"{PARAMS}(\)\s*(?:->\s*)?)([^{{;]*?)\s*(?:where\b|\{{|;|$)",
            where="any", head=1, mods=2, name=3, params=4, mid=5, ret=6,
        ),
    ),
)

_CS_TYPE_MODS = (
    r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|ref|unsafe|new)\s+)*+"
)
_CS_ATTRS = r"(?:\[[^\]]*\]\s*)*"
_CS_BASES = r"(?:\s*:\s*([^{]*?))?\s*(?:\bwhere\b[^{]*)?(?:\{|$)"
CSHARP = LangSpec(
    name="csharp",
    extensions=tuple(fv.EXTENSIONS["csharp"]),
    directive=r"^[ \t]*#",
    lexer=lexers.CSHARP,
    literals=starting(
        "/\"'$@# \t",
        SLASH_COMMENTS + "|" + TEXT_BLOCK + r'|\$?@\$?"(?:[^"]|"")*+"|' + DOUBLE_QUOTED + "|" + CHAR
        + r"|(?m:^[ \t]*#[^\n]*)"
    ),
    comment=r"^(?:/[/*]|[ \t]*#)",
    doc_style="xml",
    doc_line=r"^\s*///",
    annotation=r"^\s*\[[^\]]*\]\s*$",
    package=r"^namespace\s+([\w.]+)",
    param_style="type_first_csharp",
    quote_chars=True,
    skip_names=tuple(fv.CONTROL_WORDS) + ("catch", "lock", "using", "foreach", "base", "this"),
    skip_returns=tuple(fv.NOT_A_TYPE),
    memberless=("interface", "enum"),
    decls=(
        Decl("scope", r"^\s*namespace\s+([\w.]+)\s*(?:\{|$)", accepts=("transparent",)),
        Decl("class", rf"^\s*{_CS_ATTRS}{_CS_TYPE_MODS}class\s+(\w+){TYPE_GENERICS}{_CS_BASES}", bases=2),
        Decl(
            "class", rf"^\s*{_CS_ATTRS}{_CS_TYPE_MODS}interface\s+(\w+){TYPE_GENERICS}{_CS_BASES}",
            marker="interface", bases=2,
        ),
        Decl(
            "class", rf"^\s*{_CS_ATTRS}{_CS_TYPE_MODS}struct\s+(\w+){TYPE_GENERICS}{_CS_BASES}",
            marker="struct",
        ),
        Decl("class", rf"^\s*{_CS_ATTRS}{_CS_TYPE_MODS}enum\s+(\w+){_CS_BASES}", marker="enum", bases=2),
        Decl(
            "function", rf"^(\s*{_CS_ATTRS}({_ACCESS}\s+)(\w+)\s*\(){PARAMS}\)",
            where="member", head=1, mods=2, name=3, params=4,
        ),
        Decl(
            "function",
            rf"^(\s*{_CS_ATTRS}((?:(?:public|private|protected|internal|static|virtual|override|abstract|async|new|"
            rf"sealed|extern|partial|unsafe|readonly)\s+)*+)({_JVM_TYPES})\s+(\w+){GENERICS}\s*\(){PARAMS}\)",
            where="member", head=1, mods=2, ret=3, name=4, params=5,
        ),
    ),
)

_CPP_TYPE = r"([\w:<>, ]+?(?:\s*[*&]+\s*|\s+))"
_CPP_TAIL = r"\)\s*(?:const\b\s*)?(?:noexcept\b\s*)?(?:override\b\s*)?(?:final\b\s*)?(?:=[^{]*)?(?:->[^{;]*)?(?:[{;]|$)"
CPP = LangSpec(
    name="cpp",
    extensions=tuple(fv.EXTENSIONS["cpp"]),
    directive=r"^[ \t]*#",
    literals=starting(
        "/R\"'# \t",
        SLASH_COMMENTS + r'|R"([^()\\\s"]{0,16})\([\s\S]*?\)\1"|' + DOUBLE_QUOTED + "|" + CHAR
        + r"|(?m:^[ \t]*#[^\n\\]*+(?:\\[\s\S][^\n\\]*+)*+)"
    ),
    comment=r"^(?:/[/*]|[ \t]*#)",
    doc_block=r"^\s*/\*[*!]",
    doc_line=r"^\s*//[/!]",
    annotation=r"^\s*template\s*<.*>\s*$",
    param_style="type_first_cpp",
    quote_chars=True,
    skip_names=tuple(fv.CONTROL_WORDS[:7]) + ("catch",),
    skip_returns=tuple(fv.NOT_A_TYPE) + ("else if", "delete"),
    skip_caps_functions=True,
    memberless=("struct",),
    tag_marks=r"@\\",
    decls=(
        Decl("scope", r"^\s*(?:inline\s+)?namespace\b\s*([\w:]*)\s*(?:\{|$)", accepts=("transparent",)),
        Decl("scope", r"^\s*extern\s+\x01+\s*(?:\{|$)", name=0, accepts=("transparent",)),
        Decl(
            "class",
            r"^\s*(?:template\s*<.*?>\s*)?class\s+(?:[\w\s]*?\s)?(\w+)(?:\s+final)?(?:\s*:\s*([^{;]*?))?\s*(?:\{|$)",
            bases=2,
        ),
        Decl("class", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*(?::[^{;]*)?(?:\{|$)", marker="struct"),
        Decl(
            "function",
            r"^(\s*(?:template\s*<[^()]*?>\s*)?((?:(?:static|inline|extern|virtual|explicit|constexpr|const|unsigned|"
            rf"signed|friend)\s+(?=[\w:]+[\s*&<:]))*+){_CPP_TYPE}(\w+)\s*\(){PARAMS}{_CPP_TAIL}",
            where="any", head=1, mods=2, ret=3, name=4, params=5,
        ),
    ),
)

RUBY = LangSpec(
    name="ruby",
    extensions=tuple(fv.EXTENSIONS["ruby"]),
    lexer=lexers.RUBY,
    literals=starting("\"'=#", DOUBLE_QUOTED + "|" + SINGLE_QUOTED + r"|(?m:^=begin[\s\S]*?^=end)|#[^\n]*"),
    comment=r"^(?:#|=begin)",
    scope="end",
    doc_style="line",
    doc_line=r"^\s*#",
    annotation="",
    param_style="untyped",
    angle_brackets=False,
    decls=(
        Decl("class", r"^\s*module\s+(?:\w+::)*(\w+)", where="any", marker="module"),
        Decl("class", r"^\s*class\s+(?:\w+::)*(\w+)(?:\s*<\s*(\w[^;]*))?", where="any", bases=2),
        Decl(
            "function", rf"^(\s*def\s+(?:self\.)?(\w+[?!=]?)\s*\(){PARAMS}\)",
            where="any", head=1, name=2, params=3,
        ),
        Decl("function", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)", where="any"),
    ),
)

_KT_TYPE_MODS = (
    r"(?:(?:public|private|protected|internal|abstract|open|sealed|data|inner|enum|final|value|annotation|fun)\s+)*+"
)
KOTLIN = LangSpec(
    name="kotlin",
    extensions=tuple(fv.EXTENSIONS["kotlin"]),
    lexer=lexers.KOTLIN,
    literals=starting("/\"'", SLASH_COMMENTS + "|" + TEXT_BLOCK + "|" + DOUBLE_QUOTED + "|" + CHAR),
    comment=r"^/[/*]",
    doc_block=r"^\s*/\*\*",
    package=r"^package\s+([\w.]+)",
    param_style="name_first_colon",
    quote_chars=True,
    memberless=("interface",),
    decls=(
        Decl(
            "class",
            rf"^\s*{ANNOTATIONS}{_KT_TYPE_MODS}class\s+(\w+){TYPE_GENERICS}(?:[\w\s]*\({PARAMS}\))?"
            r"(?:\s*:\s*([^{]*?))?\s*(?:\{|$)",
            bases=3,
        ),
        Decl(
            "class", rf"^\s*{ANNOTATIONS}{_KT_TYPE_MODS}interface\s+(\w+){TYPE_GENERICS}(?:\s*:\s*([^{{]*?))?\s*(?:\{{|$)",
            marker="interface", bases=2,
        ),
        Decl(
            "class", rf"^\s*{ANNOTATIONS}(?:{_ACCESS}\s+)*+((?:companion\s+)?object)\s*(?:\{{|$)",
            marker="object",
        ),
        Decl(
            "class",
            rf"^\s*{ANNOTATIONS}(?:{_ACCESS}\s+)*+(?:data\s+)?(?:companion\s+)?object\s+(\w+)(?:\s*:\s*([^{{]*?))?\s*(?:\{{|$)",
            marker="object", bases=2,
        ),
        Decl(
            "function",
            rf"^(\s*{ANNOTATIONS}((?:(?:public|private|protected|internal|override|open|abstract|inline|suspend|operator|"
            r"infix|tailrec|external|final|actual|expect)\s+)*+)fun\s+(?:<[^()]*?>\s+)?(?:[\w<>?, ]+\.)?(\w+)\s*\()"
            rf"{PARAMS}(\)\s*(?::\s*)?)([^{{=]*?)\s*(?:\{{|=|$)",
            where="any", head=1, mods=2, name=3, params=4, mid=5, ret=6,
        ),
    ),
)

SPECS: dict[str, LangSpec] = {
    spec.name: spec
    for spec in (PYTHON, TYPESCRIPT, JAVA, GO, RUST, CSHARP, CPP, RUBY, KOTLIN)
}


@dataclass
class Registry:
    """Languages known to one job; a new language is added as data."""

    specs: dict[str, LangSpec] = field(default_factory=lambda: dict(SPECS))

    def register_language(self, spec: LangSpec) -> "Registry":
        self.specs[spec.name] = spec
        return self

    def pick(self, *names: str) -> dict[str, LangSpec]:
        return {name: self.specs[name] for name in names}

    def extensions(self) -> dict[str, str]:
        return {ext: spec.name for spec in self.specs.values() for ext in spec.extensions}


def register_language(spec: LangSpec) -> dict[str, LangSpec]:
    """All built-in languages plus ``spec``, for the ``specs`` argument of the jobs."""
    return Registry().register_language(spec).specs
