"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs that count as white space, as the content of a character class.
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def spaced(pattern: str) -> str:
    """A pattern whose white-space classes mean Unicode's white space, not ASCII's."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in (r"\s", r"\S"):
            out += WHITE if inside else f"[{'^' if two[1] == 'S' else ''}{WHITE}]"
        elif two[0] == "\\":
            out += two
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out += two[0]
            two = two[0]
        at += len(two)
    return out


#: The ranges that count as CJK.
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def clean(text: Column) -> Column:
    """Trimmed of white space; blank is null."""
    trimmed = F.regexp_replace(text, spaced(spaced(r"^\s+|\s+$")), "")
    return F.when(trimmed != "", trimmed)


def cleaned(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; blank is null."""
    line = squeezed(text)
    return F.when(line != "", line)


def has_cjk(text: Column) -> Column:
    return F.regexp_like(text, F.lit(CJK))


def compact_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, spaced(spaced(r"\s")), ""))


def for_dedup(text: Column) -> Column:
    """Lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def label(text: Column, separator: str = "_") -> Column:
    """Lower case with one separator for each run of white space, - and _."""
    return F.regexp_replace(F.lower(clean(text)), spaced(spaced(r"[\s_-]+")), separator)


def bearer(text: Column) -> Column:
    """Without a leading ``bearer `` of any case; blank is null."""
    return clean(F.regexp_replace(clean(text), spaced(spaced(r"^(?i)bearer\s+")), ""))


def similar(a: Column, b: Column, ratio: float = 0.65, least: int = 3) -> Column:
    """Equal, or one holds the other, which has ``least`` characters and this share of the length."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((F.contains(a, b) | F.contains(b, a)) & (short >= least) & (short >= ratio * long))


def token_estimate(text: Column, budget: int = 0, images: int = 0) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4.0) + 512 * images + budget).cast("long")


def markdown_line(line: Column) -> Column:
    """Without heading marks, list marks, links, code and bold marks."""
    out = F.regexp_replace(line, spaced(spaced(r"^\s{0,3}#{1,6}\s+")), "")
    out = F.regexp_replace(out, spaced(spaced(r"^\s*[-*+]\s+")), "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, "`", "")
    return F.trim(F.regexp_replace(out, r"\*\*", ""))


#: Labels and openings of recognition prompts that models echo.
ECHO_LABELS = ("text", "image", "figure", "icon", "diagram", "chart", "logo", "subtitle", "sub_title", "equation", "formula", "table", "title", "caption", "footnote", "header", "footer")
ECHO_OPENINGS = (
    "ocr task",
    "image size",
    "return line-level ocr",
    "return line level ocr",
    "preferred format",
    "json array is also accepted",
    "each item must be one visual text line",
    "coordinates are pixel values",
    "stop immediately after json closes",
)


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), spaced(spaced(r"\s+")), " "))


def prompt_echo(text: Column) -> Column:
    """Whether the text is a generic label, a region number or the opening of a prompt."""
    t = F.lower(squeezed(text))
    opening = F.lit(False)
    for words in ECHO_OPENINGS:
        opening = opening | F.startswith(t, F.lit(words))
    return t.isin(*ECHO_LABELS) | F.regexp_like(t, F.lit(spaced(r"^region[_\s-]?[0-9]{1,4}$"))) | opening | (F.contains(t, F.lit("return line-level ocr")) & F.contains(t, F.lit("bbox")))


def gibberish(text: Column) -> Column:
    """Whether 64 or more characters are nearly all JSON delimiters, or repeat closing runs."""
    packed = F.regexp_replace(F.coalesce(text, F.lit("")), spaced(spaced(r"\s")), "")
    n = F.length(packed)
    delimiters = F.regexp_count(packed, F.lit(r"[{}\[\],:]"))
    letters = F.regexp_count(packed, F.lit(r"[\p{L}\p{N}]"))
    runs = F.regexp_count(packed, F.lit(r"\}\}\]\}")) + F.regexp_count(packed, F.lit(r"\}\]\}\]"))
    return (n >= 64) & (((delimiters >= 0.88 * n) & (letters <= 0.06 * n)) | ((runs > 0) & (runs >= F.greatest(F.lit(6), F.floor(n / 80)))))


def short_token(text: Column) -> Column:
    """Whether a text is a label-like token and no body text: very short, bracketed, or a few letters or digits."""
    raw = F.coalesce(clean(text), F.lit(""))
    n = compact_length(raw)
    cjk = F.regexp_count(raw, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    marks = F.regexp_count(raw, F.lit(spaced(r"[^\p{L}\p{N}\s]")))
    latin = (F.regexp_count(raw, F.lit(r"\p{L}")) >= 2) & (marks <= 2)
    figures = F.regexp_count(raw, F.lit(r"\p{Nd}")) >= 2
    return (n > 0) & ((n <= 3) | ((n <= 12) & F.regexp_like(raw, F.lit("[()/]"))) | ((n <= 6) & (cjk == 0) & (latin | figures)))


def needs_space(before: Column, after: Column) -> Column:
    """Whether two tokens of one line are joined with a blank: no CJK in either, letters or digits where they meet."""
    ends = F.regexp_like(before, F.lit(r"[\p{L}\p{N}]$")) & F.regexp_like(after, F.lit(r"^[\p{L}\p{N}]"))
    return F.coalesce(ends & ~has_cjk(before) & ~has_cjk(after), F.lit(False))


def render_lines(text: Column) -> Column:
    """Lines trimmed and blank ones gone, with any line end read as a line feed."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, spaced(spaced(r"^\s+|\s+$")), ""))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def heading_lines(text: Column) -> Column:
    """A one-line heading cut behind its first colon, wide or narrow, when its left part has brackets
    and its right part brackets, a joining sign, or Latin letters stand on either side."""
    line = render_lines(text)
    out = line
    for colon in (":", "："):  # the wide one is tried first, so it stands outermost
        at = F.instr(line, colon)
        left, right = F.trim(F.substring(line, F.lit(1), at)), F.trim(F.substring(line, at + 1, F.length(line)))

        def bracketed(part: Column) -> Column:
            return (F.contains(part, F.lit("(")) & F.contains(part, F.lit(")"))) | (F.contains(part, F.lit("（")) & F.contains(part, F.lit("）")))

        tail = bracketed(right) | F.regexp_like(right, F.lit("[/&+、]")) | F.regexp_like(F.concat(left, right), F.lit("[A-Za-z]"))
        fits = (at >= 3) & (at < F.length(line) - 1) & (compact_length(right) >= 2) & bracketed(left) & tail
        out = F.when(fits, F.concat(left, F.lit("\n"), right)).otherwise(out)
    return F.when(F.contains(line, F.lit("\n")), line).otherwise(out)


def sentences(text: Column) -> Column:
    """Sentences of a text, each with its closing mark."""
    parts = F.split(squeezed(text), r"(?<=[。！？!?；;])")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def flag(text: Column) -> Column:
    """True or false from the words and numbers that style payloads use, else null."""
    t = F.lower(clean(text))
    heavy = F.when(F.regexp_like(t, F.lit("^[0-9]{1,9}$")), t.cast("int") >= 600)
    return F.when(t.isin("true", "1", "yes", "y", "on", "bold", "semibold"), True).when(t.isin("false", "0", "no", "n", "off", "normal", "regular"), False).otherwise(heavy)


def retry_delay(attempt: Column, status: Column) -> Column:
    """Seconds before the next attempt: doubled from 0.75 up to 8, and 2 at least when the limit was hit."""
    base = F.least(F.lit(8.0), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt)) * 0.75)
    return F.greatest(F.when(status == 429, 2.0).otherwise(0.25), base)


def short_text(text: Column, limit: int = 160) -> Column:
    """Squeezed to one line and cut to ``limit`` characters, dots included."""
    line = squeezed(text)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.left(line, F.lit(max(0, limit - 3))), F.lit("...")))


def wrap_tokens(text: Column) -> Column:
    """Tokens that a line break may part: words and the blanks between them; where CJK stands or no blank does,
    runs of ASCII word characters, single other characters, and one blank for a run of white space."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    parted = F.flatten(F.transform(words, lambda w, i: F.when(i > 0, F.array(F.lit(" "), w)).otherwise(F.array(w))))
    runs = F.regexp_extract_all(text, F.lit(spaced(r"(\s+|[A-Za-z0-9_\-./:+#%&@]+|\S)")), F.lit(1))
    mixed = F.transform(runs, lambda r: F.when(F.regexp_like(r, F.lit(spaced(r"^\s"))), " ").otherwise(r))
    return F.when(~has_cjk(text) & F.contains(text, F.lit(" ")), parted).otherwise(mixed)


def message_text(content: Column) -> Column:
    """The text of a message from its content as JSON text: a string, or a list of strings and of objects with
    a string below ``text`` or else ``content``; these trimmed, one to a line. Null is empty."""

    def string(value: Column) -> Column:
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    value = F.try_parse_json(content)
    parts = F.try_variant_get(value, "$", "array<variant>")
    below = ("$.text", "$.content")
    texts = F.transform(parts, lambda p: clean(F.coalesce(string(p), *(string(F.try_variant_get(p, k, "variant")) for k in below))))
    return F.coalesce(string(value), F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n"), F.lit(""))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its known ``{{ name }}`` filled in and trimmed; unknown names stay, null values are empty.

    A template is cut at its names first, so a value that looks like one is not filled in again.
    """
    parts = F.regexp_extract_all(template, F.lit(spaced(r"(\{\{\s*[a-zA-Z0-9_]+\s*\}\}|(?s:.+?)(?=\{\{\s*[a-zA-Z0-9_]+\s*\}\}|\z))")), F.lit(1))

    def fill(part: Column) -> Column:
        name = F.regexp_extract(part, spaced(spaced(r"^\{\{\s*([a-zA-Z0-9_]+)\s*\}\}$")), 1)
        out = part
        for key, value in values.items():
            out = F.when(name == key, F.coalesce(value, F.lit(""))).otherwise(out)
        return out

    return F.regexp_replace(F.array_join(F.transform(parts, fill), ""), spaced(spaced(r"^\s+|\s+$")), "")


#: The XML entities, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def without_tags(text: Column) -> Column:
    """Without ``<|name|>`` tags, which may be escaped up to twice, and squeezed; of entities those of XML are known."""
    out = F.coalesce(text, F.lit(""))
    for _ in range(2):
        for entity, sign in ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(sign))
    return squeezed(F.regexp_replace(out, r"<\|/?[a-zA-Z0-9_]+\|>", ""))
