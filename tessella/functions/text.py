r"""Scalar text functions as Column expressions.

White space is Java's ``\s`` (ASCII), which other SQL engines share. Patterns are
raw strings; every function takes a Column or a column name and returns a Column
that stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of secrets, in the order in which they are replaced.
SECRET_PATTERNS = (
    r"sk-[a-zA-Z0-9]{20,}",
    r"pk-[a-zA-Z0-9]{20,}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"gho_[a-zA-Z0-9]{36}",
    r"github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[0-9A-Za-z\-_]{35}",
    r"(?i)Bearer\s+[a-zA-Z0-9\-._~+/]+=*",
    r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
    r"(?i)(?:postgres|mysql|mongodb|redis)://[^:]+:[^@]+@[^/\s]+",
)
# Names that hold secrets.
SECRET_ENV_NAMES = (
    "(?i)(?:API_KEY|API_SECRET|SECRET_KEY|ACCESS_TOKEN|AUTH_TOKEN|PRIVATE_KEY|DATABASE_URL|MONGODB_URI"
    "|REDIS_URL|SMTP_PASSWORD)"
)
SECRET_CONFIG_KEYS = (
    "(?i)(?:apiKey|apiSecret|secretKey|accessToken|authToken|privateKey|password|databaseUrl|token)"
)
REDACTED = "[REDACTED]"
WORDS_PER_MINUTE = 200


def col(c: Column | str) -> Column:
    """A Column of a name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def _replace(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return _replace(col(c), (r"^\s+", ""), (r"\s+$", ""))


def strip_html(c: Column | str) -> Column:
    """Without tags, white space collapsed."""
    return F.trim(_replace(col(c), ("<[^>]+>", ""), (r"\s+", " ")))


def truncate_words(c: Column | str, size: int) -> Column:
    """At most ``size`` characters, cut at the last space if there is one after the first character."""
    c = col(c)
    head = F.substring(c, 1, size)
    cut = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    return (
        F.when(F.length(c) <= size, c)
        .when((F.instr(head, " ") > 0) & (cut > 0), F.substr(head, F.lit(1), cut))
        .otherwise(head)
    )


def describe(c: Column | str, size: int = 160, least: int = 80) -> Column:
    """A paragraph without markup, at most ``size`` characters, cut at a space if one is late enough."""
    text = strip(
        _replace(
            col(c),
            ("`([^`]*)`", "$1"),
            (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
            (r"\[([^\]]*)\]\([^)]*\)", "$1"),
            (r"[#*_~\[\]()>]", ""),
        )
    )
    head = F.substring(text, 1, size)
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    late = (F.instr(head, " ") > 0) & (cut >= least)
    short = F.when(late, F.substr(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.length(text) <= size, text).otherwise(F.regexp_replace(short, r"\s+$", ""))


def _entities(c: Column, quote: str) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def escape_html(c: Column | str) -> Column:
    """HTML-escaped, also fit for a url attribute."""
    return _entities(col(c), "&#39;")


def escape_xml(c: Column | str) -> Column:
    """XML-escaped."""
    return _entities(col(c), "&apos;")


def redact(c: Column | str, by: str = REDACTED, extra: tuple[str, ...] = ()) -> Column:
    """With everything that looks like a secret replaced."""
    return _replace(col(c), *[(p, by.replace("$", r"\$")) for p in (*SECRET_PATTERNS, *extra)])


def is_secret_env_name(c: Column | str) -> Column:
    """Whether an environment variable of this name holds a secret."""
    return col(c).rlike(SECRET_ENV_NAMES)


def is_secret_config_key(c: Column | str) -> Column:
    """Whether a configuration key of this name holds a secret."""
    return col(c).rlike(SECRET_CONFIG_KEYS)


def sanitize_config_value(key: Column | str, value: Column | str) -> Column:
    """The value, hidden if its key holds a secret and it is not empty."""
    return F.when(is_secret_config_key(key) & (F.length(col(value)) > 0), F.lit(REDACTED)).otherwise(col(value))


def hash16(c: Column | str) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def fnv1a32(c: Column | str) -> Column:
    """FNV-1a, 32 bits, over UTF-16 units, as eight hex digits."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    points = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    high = lambda p: F.lit(0xD800).cast("long") + F.shiftright(p - 0x10000, 10)
    low = lambda p: F.lit(0xDC00).cast("long") + p % 0x400
    points = F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(high(p), low(p)))))
    value = F.aggregate(
        points,
        F.lit(0x811C9DC5).cast("long"),
        lambda h, p: ((h.bitwiseXOR(p)) * F.lit(0x01000193).cast("long")).bitwiseAND(mask),
    )
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix:hash`` of the joined parts; the prefix alone if they are empty."""
    joined = F.concat_ws("|", *[col(p) for p in parts])
    return F.when(F.length(joined) == 0, F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}:"), fnv1a32(joined)))


def normalize_compare(c: Column | str) -> Column:
    """The form in which texts are compared: white space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def strip_semantics(c: Column | str) -> Column:
    """Source without comments, blank lines and indentation.

    A line with ``//`` before any quote is a comment if its quotes are even in number.
    """
    lines = F.split(F.regexp_replace(col(c), r"/\*[\s\S]*?\*/", ""), r"\r?\n")
    comment = lambda x: x.rlike(r"""^[^"']*//""") & (F.regexp_count(x, F.lit("[\"'`]")) % 2 == 0)
    code = F.filter(lines, lambda x: ~comment(x))
    return F.array_join(F.filter(F.transform(code, strip), lambda x: x != ""), "\n")


def semantic_hash(c: Column | str) -> Column:
    """Hash that formatting and comments do not change."""
    return hash16(strip_semantics(c))


def slugify_heading(c: Column | str) -> Column:
    """Anchor of a heading: word characters and hyphens, white space to hyphens."""
    return _replace(strip(F.lower(col(c))), (r"[^\w\s-]", ""), (r"\s+", "-"))


def slugify_file(c: Column | str) -> Column:
    """Like a heading's, with underscores as hyphens and none at the ends."""
    return _replace(F.lower(col(c)), (r"[^\w\s-]", ""), (r"[\s_]+", "-"), ("^-+", ""), ("-+$", ""))


def slugify_page(c: Column | str) -> Column:
    """Runs of anything but a-z and 0-9 as one hyphen, none at the ends."""
    return _replace(F.lower(col(c)), ("[^a-z0-9]+", "-"), ("^-+", ""), ("-+$", ""))


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def capitalize(c: Column | str) -> Column:
    """First character in upper case."""
    return _capital(col(c))


def title_case(c: Column | str) -> Column:
    """Words of a file name, each capitalised; words all in capitals and digits stay."""
    parts = F.filter(F.split(col(c), "[-_]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^[A-Z0-9]+\z"), x).otherwise(_capital(x))), " ")


def titleize(c: Column | str) -> Column:
    """Parts between hyphens or underscores, each capitalised."""
    return F.array_join(F.transform(F.split(col(c), "[-_]"), _capital), " ")


def strip_markdown(c: Column | str) -> Column:
    """Inline markup removed, its text kept."""
    return _replace(
        col(c),
        ("`([^`]*)`", "$1"),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\*\*(.*?)\*\*|__(.*?)__", "$1$2"),
        (r"\*(.*?)\*|_(.*?)_", "$1$2"),
        ("~~(.*?)~~", "$1"),
        (r"\{@link\s+([^}|]+)(?:\|[^}]*)?\}", "$1"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&#123;", "{"),
        ("&#125;", "}"),
    )


def normalize_body(c: Column | str) -> Column:
    """Unix line ends, at most one blank line, trimmed, one line end at the end."""
    return F.concat(strip(_replace(col(c), ("\r\n", "\n"), ("\n{3,}", "\n\n"))), F.lit("\n"))


def normalize_example(c: Column | str) -> Column:
    """Example code without trailing blanks, runs of blank lines, leading and trailing blank lines."""
    return _replace(col(c), ("\r\n", "\n"), (r"(?m)[ \t]+$", ""), ("\n{3,}", "\n\n"), (r"^\n+", ""), (r"\s+\z", ""))


def dedent_example(c: Column | str) -> Column:
    """Example code without the indentation that all its non-blank lines share."""
    lines = F.split(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), "\n")
    indent = F.array_min(
        F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0)))
    )
    cut = F.array_join(F.transform(lines, lambda x: F.substr(x, indent + 1)), "\n")
    return F.when(indent > 0, cut).otherwise(col(c))


def language_from_info(c: Column | str) -> Column:
    """Language of a fence's info string, ``text`` if it has none."""
    word = F.element_at(F.split(F.lower(strip(F.coalesce(col(c), F.lit("")))), r"\s+"), 1)
    return F.when(word != "", word).otherwise(F.lit("text"))


def is_relative_specifier(c: Column | str) -> Column:
    """Whether an import names a file of the project."""
    return col(c).rlike(r"^(?:\.\.?(?:/|\z)|/)")


def package_name(c: Column | str) -> Column:
    """Package that a bare import names, with its scope; null for a relative one."""
    text = strip(c)
    parts = F.filter(F.split(text, "/"), lambda x: x != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    bare = (text != "") & ~is_relative_specifier(text) & ~text.startswith("#")
    name = F.when(~first.startswith("@"), first).when(second.isNotNull(), F.concat(first, F.lit("/"), second))
    return F.when(bare, name)


def classify_specifier(c: Column | str, workspace: list[str]) -> Column:
    """unknown, module, workspace or package."""
    name = package_name(c)
    return (
        F.when(col(c) == "", "unknown").when(is_relative_specifier(c), "module").when(name.isNull(), "unknown")
        .when(name.isin(workspace), "workspace").otherwise("package")
    )


def version_parts(c: Column | str) -> Column:
    """Numbers that the parts of a version before its pre-release begin with; other parts are left out."""
    parts = F.split(F.element_at(F.split(col(c), "-"), 1), r"\.")
    numbers = F.transform(parts, lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1))
    return F.transform(F.filter(numbers, lambda x: x != ""), lambda x: x.cast("long"))


def compare_versions(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by number parts, then a pre-release before its release, then by text."""
    pad = lambda c: F.slice(F.concat(version_parts(c), F.array_repeat(F.lit(0).cast("long"), 8)), 1, 8)
    x, y = pad(a), pad(b)
    pre = lambda c: F.when(F.instr(col(c), "-") > 0, F.regexp_extract(col(c), "^[^-]*-([\\s\\S]*)", 1))
    p, q = pre(a), pre(b)
    return (
        F.when(x < y, -1).when(x > y, 1)
        .when(p.isNotNull() & q.isNull(), -1).when(p.isNull() & q.isNotNull(), 1)
        .when(p < q, -1).when(p > q, 1).otherwise(0)
    )


def satisfies_version(version: Column | str, requirement: Column | str) -> Column:
    """Whether a version meets ``= > >= < <= ^ ~`` and a version, or no requirement at all."""
    text = strip(requirement)
    operator = F.regexp_extract(text, r"^(>=|<=|>|<|\^|~|=)?", 1)
    rest = strip(F.substr(text, F.length(operator) + 1))
    numeric = F.element_at(F.split(rest, "-"), 1).rlike(r"^\d+(?:\.\d+)*\z")
    order = compare_versions(version, rest)
    part = lambda c, k: F.get(version_parts(c), F.lit(k))
    major = part(version, 0).eqNullSafe(part(rest, 0))
    met = (
        F.when(operator.isin("", "="), order == 0).when(operator == ">", order > 0).when(operator == ">=", order >= 0)
        .when(operator == "<", order < 0).when(operator == "<=", order <= 0)
        .when(operator == "^", (order >= 0) & major)
        .otherwise((order >= 0) & major & part(version, 1).eqNullSafe(part(rest, 1)))
    )
    return F.when(text == "", F.lit(True)).when((rest == "") | ~numeric, F.lit(False)).otherwise(met)


def export_names(c: Column | str) -> Column:
    """Names that a source text exports: declarations, then lists with their aliases."""
    named = F.regexp_extract_all(
        col(c),
        F.lit(r"export\s+(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"),
        F.lit(1),
    )
    lists = F.regexp_extract_all(col(c), F.lit(r"export\s*\{([^}]+)\}"), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    alias = F.transform(parts, lambda x: strip(F.element_at(F.split(strip(x), r"\s+as\s+"), -1)))
    return F.array_distinct(F.concat(named, F.filter(alias, lambda x: x.rlike(r"^[\w$]+\z"))))


def markdown_targets(c: Column | str) -> Column:
    """Targets of all Markdown links, in order."""
    return F.regexp_extract_all(col(c), F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))


def normalize_target(c: Column | str) -> Column:
    """A link target without slashes at its ends and without a Markdown extension."""
    return _replace(col(c), ("^/+", ""), ("/+$", ""), (r"(?i)\.(?:md|mdx)\z", ""))


def word_count(c: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda w: w != "")).cast("long")


def reading_minutes(words: Column | str) -> Column:
    """Whole minutes to read so many words, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(col(words) / F.lit(float(WORDS_PER_MINUTE))))


def token_estimate(c: Column | str) -> Column:
    """Tokens of a text at four characters each."""
    return F.ceil(F.length(col(c)) / F.lit(4.0))


def clamp(c: Column | str) -> Column:
    """Between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def is_calendar_date(c: Column | str) -> Column:
    """Whether a text is an existing day as YYYY-MM-DD."""
    shape = col(c).rlike(r"^\d{4}-\d{2}-\d{2}\z")
    return F.coalesce(shape & (F.date_format(F.try_to_date(col(c), "yyyy-MM-dd"), "yyyy-MM-dd") == col(c)), F.lit(False))


def type_references(c: Column | str) -> Column:
    """Capitalised names in a type, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(?<![A-Za-z0-9_])([A-Z]\w+)"), F.lit(1)))


def markdown_title(c: Column | str) -> Column:
    """Text of the first level-one heading, ``Untitled`` if there is none."""
    found = F.regexp_extract(col(c), r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", found).otherwise(F.lit("Untitled"))


def markdown_description(c: Column | str, size: int = 160) -> Column:
    """First paragraph after the title without tags and markup, cut at ``size``."""
    # only the first title goes; the rest of the text is kept behind a marker-free split
    head = F.regexp_extract(col(c), r"\A([\s\S]*?)(?:(?m:^)#\s+.+(?m:$)|\z)", 1)
    tail = F.regexp_replace(col(c), r"\A[\s\S]*?(?:(?m:^)#\s+.+(?m:$)|\z)", "")
    first = F.element_at(F.split(strip(F.concat(head, tail)), "\n\n"), 1)
    return F.substring(strip(_replace(first, ("<[^>]+>", ""), (r"[#*_`~\[\]()>]", ""))), 1, size)


def callout_tone(c: Column | str) -> Column:
    """Tone of a callout by how its text begins."""
    text = F.lower(col(c))
    return (
        F.when(text.startswith("warning"), "warning").when(text.startswith("deprecated"), "deprecated")
        .when(text.startswith("tip"), "tip").otherwise("note")
    )
