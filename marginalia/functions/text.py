"""Column expressions over text: tokens, normalisation, hashes, sentences, names and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.wordlists import IMAGES, PDF, UNSAFE

#: Letters with diacritics and what search folds them to; ß stays.
FOLD_FROM, FOLD_TO = "äöüáàâãåéèêëíìîïóòôõúùûçñý", "aouaaaaaeeeeiiiioooouuucny"


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def index_tokens(c: Column) -> Column:
    """Search tokens: runs of letters and digits, lower case, without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def keyword_tokens(c: Column, least: int = 4) -> Column:
    """Whole words of Latin and German letters with at least ``least`` of them; one pass of one pattern."""
    edge = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?<!{edge})([a-zäöüß]{{{least},}})(?!{edge})"), F.lit(1))


def token_count(c: Column) -> Column:
    """The number of ``index_tokens``; folding does not change it."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))


def term_frequency(low: Column, term: str) -> Column:
    """How many ``index_tokens`` of a lower-case text equal a folded term: its letters stand for their variants instead."""
    def variants(ch: str) -> str:
        same = "".join(f for f, t in zip(FOLD_FROM, FOLD_TO) if t == ch)
        return f"[{ch}{same}]" if same else ch

    return F.regexp_count(low, F.lit(r"(?<![\p{L}\p{N}])" + "".join(map(variants, term)) + r"(?![\p{L}\p{N}])"))


def umlauts(c: Column) -> Column:
    """Lower case with ä, ö, ü, ß spelt out."""
    c = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def keyword_array(raw: Column) -> Column:
    """Keywords of a JSON array, else of a comma list; trimmed, without empty ones. Null and blank give an empty array."""
    parsed = F.from_json(raw, "array<string>")
    listed = F.when(F.ltrim(raw).startswith("["), parsed).otherwise(F.split(raw, ","))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != "")


def embedding_text(header: Column, content: Column, keywords: Column) -> Column:
    """Header twice, the first 500 characters of the content and up to ten keywords, joined by bars; empty parts are left out."""
    part = lambda c: F.when(c != "", c)
    return F.concat_ws(" | ", part(header), part(header), F.when(content != "", F.trim(F.substring(content, 1, 500))), part(F.array_join(F.slice(keywords, 1, 10), " ")))


def short_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(c, 256), 1, 16))


def sentences(c: Column) -> Column:
    """Pieces that end in . ! or ? before white space, trimmed, without empty ones."""
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def file_category(path: Column) -> Column:
    """Category of a note by its name and folder; the first rule that holds counts, ``dokumentation`` otherwise."""
    parts = F.split(path, "/")
    name, parent = F.lower(F.element_at(parts, -1)), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    return (
        F.when(parent.contains("learnings") | name.contains("learning"), "learnings")
        .when(name.contains("adr") | parent.contains("architecture"), "adr")
        .when(name.contains("briefing"), "briefing")
        .when(path.contains("projektplanung"), "projektplanung")
        .otherwise("dokumentation")
    )


def path_category(path: Column, kind: str = "pdf") -> Column:
    """Category of a PDF (``pdf``) or an image (``image``) by what its path contains."""
    low, out = F.lower(path), F.lit("dokumentation")
    for name, marks in reversed({"pdf": PDF, "image": IMAGES}[kind]):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | low.contains(mark)
        out = F.when(hit, name).otherwise(out)
    return out


def suffix(path: Column) -> Column:
    """File suffix in lower case without the point; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def heading_slug(c: Column) -> Column:
    """Lower case, blanks to hyphens, only a-z, 0-9 and hyphens, hyphens squeezed and trimmed."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", "-"), r"[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")


def note_slug(c: Column) -> Column:
    """The other slug: lower case, each blank to a hyphen, only letters, digits and hyphens of any alphabet, hyphens trimmed."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", ""), "^-+|-+$", "")


def safe_path(c: Column) -> Column:
    """Whether a relative path stays below its root: not empty, no control characters, no leading slash, drive or ``..`` step."""
    parts = F.split(F.regexp_replace(c, r"\\", "/"), "/")
    bad = c.rlike(r"[\x00-\x1f\x7f]") | c.rlike(r"^(?:[/\\~]|[A-Za-z]:)") | F.array_contains(parts, "..")
    return F.coalesce((c != "") & ~bad, F.lit(False))


def vector_hash(c: Column) -> Column:
    """SHA-256 of a vector's numbers in millionths, so that it does not depend on how numbers are printed; null and empty vectors have none."""
    return F.when(F.size(c) > 0, F.sha2(F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ","), 256))


def essence_hash(title: Column, summary: Column) -> Column:
    """The first 16 characters of the SHA-256 of title and summary; the time is no part of it, so it is repeatable."""
    return F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))), 256), 1, 16)


def page_embedding_text(header: Column, preview: Column, keywords: Column) -> Column:
    """Text of an extracted page for embedding: header, preview and the first 100 characters of its keywords, joined by bars."""
    return F.concat_ws(" | ", header, preview, F.concat(F.lit("Keywords: "), F.substring(F.array_join(keywords, ", "), 1, 100)))


def backoff(delay: Column, attempt: Column) -> Column:
    """Seconds to wait before the next attempt: the delay doubled with each one."""
    return delay * F.pow(F.lit(2.0), attempt)


def or_zeros(vector: Column, dim: int) -> Column:
    """The vector, or zeros where a batch failed to give one."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dim))


# How long texts may be where they are stored.
LIMITS = {"header": 200, "document": 2000, "error": 500, "body": 5000}


def cut(c: Column, kind: str) -> Column:
    """A text cut to what is stored of its kind (``LIMITS``)."""
    return F.substring(c, 1, LIMITS[kind])


def answer_fields(raw: Column, schema: str, defaults: dict[str, Column]) -> Column:
    """The JSON object in a model's answer (``json_object``) as a struct; missing or wrong fields have their defaults."""
    parsed = F.from_json(json_object(raw), schema)
    return F.struct(*[F.coalesce(parsed[n], d).alias(n) for n, d in defaults.items()])


def safe_name(c: Column) -> Column:
    """A title as file name: reserved characters and white space to underscores, at most 200 characters."""
    plain = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r'[/\\:*?"<>|#]', "_")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\s+", "_"), 1, 200)


def safe_file_name(c: Column) -> Column:
    """Any characters but Latin letters, digits, point, underscore and hyphen to underscores, at most 255; ``unnamed`` if nothing is left."""
    plain = F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "_")
    ending = F.regexp_extract(plain, r"(\.[^.]*)$", 1)
    return F.when(F.coalesce(c, F.lit("")) == "", "unnamed").when(F.length(plain) > 255, F.concat(F.substring(F.regexp_replace(plain, r"\.[^.]*$", ""), 1, 250), ending)).otherwise(plain)


def is_safe_query(c: Column) -> Column:
    """No mark of ``UNSAFE``, not empty and at most 1,000 characters."""
    low = F.lower(c)
    bad = F.lit(False)
    for mark in UNSAFE:
        bad = bad | low.contains(mark)
    return F.coalesce(~bad & (F.length(c) <= 1000) & (c != ""), F.lit(False))


def clean_query(c: Column) -> Column:
    """Without control characters, at most 1,000 characters, trimmed."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f]", ""), 1, 1000), r"^\s+|\s+$", "")


def size_text(n: Column) -> Column:
    """Bytes with one decimal in the greatest unit of B, KB, MB, GB, TB that fits."""
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return (
        F.when(seconds < 1, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 60, F.format_string("%.0fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def location(path: Column, line: Column) -> Column:
    """``file:line``, or the file's name where no line is known."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(line > 0, F.concat_ws(":", name, line.cast("string"))).otherwise(name)


def shown(c: Column, most: int = 80) -> Column:
    """One line of at most ``most`` characters."""
    flat = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def frontmatter_text(fields: Column) -> Column:
    """A map as a frontmatter block, keys in their order."""
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n")))
    return F.concat(F.lit("---\n"), F.array_join(lines, ""), F.lit("---\n"))


# The headings of a summary's analysis and what stands there if it has none.
ANALYSIS = {"connections": "Verknüpfungen", "contradictions": "Widersprüche", "questions": "Offene Fragen", "none": "Keine zusätzlichen Analysen verfügbar."}


def essence_body(connections: Column, contradictions: Column, questions: Column) -> Column:
    """The analysis part of a summary as Markdown."""
    def part(title: str, mark: str, items: Column) -> Column:
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- " + mark), x)), "\n")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), lines, F.lit("\n")))

    body = F.concat_ws("\n", part(ANALYSIS["connections"], "", connections), part(ANALYSIS["contradictions"], "⚠️ ", contradictions), part(ANALYSIS["questions"], "❓ ", questions))
    return F.when(body == "", ANALYSIS["none"]).otherwise(body)


def report_title(kind: Column, start: Column, end: Column) -> Column:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return (
        F.when(kind == "daily", F.concat(F.lit("Daily Report — "), day(start)))
        .when(kind == "weekly", F.concat(F.lit("Weekly Report — "), day(start), F.lit(" bis "), day(end)))
        .otherwise(F.concat(F.lit("Monthly Report — "), F.date_format(start, "yyyy-MM")))
    )


def json_object(raw: Column) -> Column:
    """The JSON object in a model's answer: inside a code fence if there is one, from the first brace to the one that balances it; braces in strings do not count."""
    text = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?(.*?)```", 1), F.lit("")), raw)
    start = F.instr(text, "{")
    tail = F.substring(text, start, F.length(text))
    # strings, braces and the text between them, so that a step takes a token instead of a character
    tokens = F.regexp_extract_all(tail, F.lit(r'("(?:[^"\\]|\\.)*"|[{}]|[^"{}]+|")'), F.lit(1))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")).cast("struct<depth:int,at:int,end:int>")

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        end = F.when((s["end"] == 0) & (depth == 0) & (t == "}"), s["at"] + 1).otherwise(s["end"])
        return F.struct(depth.alias("depth"), (s["at"] + F.length(t)).alias("at"), end.alias("end"))

    end = F.aggregate(tokens, zero, step, lambda s: s["end"])
    return F.when(start > 0, F.when(end > 0, F.substring(tail, F.lit(1), end)).otherwise(tail))


def hashed_vector(tokens: Column, dim: int = 64) -> Column:
    """A deterministic embedding: signed counts of hashed tokens, of length one; a text without tokens gives zeros. Work grows with tokens plus dimensions."""
    signed = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)) * 2 + F.pmod(F.hash(t), F.lit(2)))
    order = F.array_sort(F.concat(signed, F.sequence(F.lit(0).cast("bigint"), F.lit(2 * dim).cast("bigint"))))
    # where each value begins in the sorted array, which holds every value at least once; the array is bound to a variable, so it is sorted once
    begins = lambda o: F.filter(F.transform(o, lambda x, i: F.when((i == 0) | (F.get(o, i - 1) != x), i)), lambda i: i.isNotNull())
    starts = F.element_at(F.transform(F.array(order), begins), 1)
    counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (2 * F.get(s, d * 2 + 1) - F.get(s, d * 2) - F.get(s, d * 2 + 2)).cast("double"))
    raw = F.element_at(F.transform(F.array(starts), counts), 1)
    def unit(r: Column) -> Column:
        norm = F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(r, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))

    return F.element_at(F.transform(F.array(raw), unit), 1)


def importance(c: Column) -> Column:
    """A missing or zero importance counts as 0.5."""
    return F.when(c.isNull() | (c == 0), F.lit(0.5)).otherwise(c)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null if one is null, empty or zero, or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
