"""Text functions as column expressions: excerpts, guards, terms and quality measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def excerpt(text: Column, limit: int = 900, look_back: int = 80) -> tuple[Column, Column]:
    """The first ``limit`` characters without a last broken word, if a space is near the end; and whether it was cut."""
    cut = F.char_length(text) > limit
    head = F.substring(text, 1, limit)
    near = F.contains(F.substring(text, limit - look_back + 1, look_back), F.lit(" "))
    return F.when(cut & near, F.regexp_replace(head, r"(?s) [^ ]*\z", "")).otherwise(head), F.coalesce(cut, F.lit(False))


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from one, joined by line feeds."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def line_ranges(text: Column, ranges: list[tuple[int, int]]) -> Column:
    """Several ranges of lines, with a mark where lines are left out between them."""
    return F.concat_ws("\n[…]\n", *[line_range(text, first, last) for first, last in ranges])


def ranges_label(ranges: list[tuple[int, int]]) -> str:
    return ", ".join(range_label(first, last) for first, last in ranges)


def range_label(first: int, last: int) -> str:
    return f"{first}–{last}" if last > first else f"{first}"


def sheet_guard(cell: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def table_escape(cell: Column) -> Column:
    """A cell for a pipe-delimited text table."""
    return F.regexp_replace(F.replace(cell, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def is_slug(value: Column) -> Column:
    """Lower-case letters, digits, dashes and underscores, 3 to 64 of them, a letter or digit first; nothing else, not even a line end."""
    return value.rlike(r"\A[a-z0-9][a-z0-9_-]{2,63}\z")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def terms_in(text: Column, words: list[str], inside: list[str]) -> Column:
    """Distinct terms found, sorted: ``words`` bounded by other characters, ``inside`` anywhere."""
    low = F.lower(text)
    found = [F.when(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])"), F.lit(w)) for w in words]
    found += [F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in inside]
    return F.array_sort(F.array_compact(F.array(*found)))


def has_all(text: Column, terms: list[str]) -> Column:
    """Whether the text holds every term, in any case."""
    low = F.lower(text)
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(low, F.lit(t.lower()))
    return out


# Signatures of credentials that must not be published. Only their names are reported.
SECRETS = {
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "fine-grained token": r"github_pat_[A-Za-z0-9_]{20,}",
    "service token": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "access key": r"AKIA[0-9A-Z]{16}",
    "model key": r"sk-[A-Za-z0-9]{32,}",
    "chat token": r"xox[baprs]-[A-Za-z0-9-]{20,}",
}
# Folders, beginnings and ends of names that must not be published, and the size of a file that may be.
_FOLDERS = (".venv/", ".language-venv/", ".devin/", "cache/", "historical/", "__pycache__/")
_ENDS = (".log", ".pem", ".key", ".zip", ".gz", ".whl")
_LARGEST = 2_000_000


def path_issue(path: Column, size: Column) -> Column:
    """Why a file must not be published by its name or size; null if it may."""
    forbidden = F.lit(False)
    for folder in _FOLDERS:
        forbidden = forbidden | F.startswith(path, F.lit(folder))
    for end in _ENDS:
        forbidden = forbidden | F.endswith(path, F.lit(end))
    forbidden = forbidden | F.contains(F.lower(path), F.lit("/backup")) | F.startswith(F.substring_index(path, "/", -1), F.lit(".env"))
    return F.when(forbidden, "forbidden path").when(size > _LARGEST, "too large")


def secret_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in SECRETS.items()]))


def alphabetic(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))


def sentence_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?。！？]"))


def paragraphs(text: Column, least_letters: int = 80) -> Column:
    """Lines that hold at least so many letters."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.size(F.filter(lines, lambda x: F.char_length(F.regexp_replace(x, r"[^\p{L}]", "")) >= least_letters))


# What titles of error, consent and check pages say, in four languages.
ERROR_TITLES = (
    "page not found", "access denied", "just a moment", "verify you are human", "error 404", "404 not found", "seite nicht gefunden", "página no encontrada", "page introuvable", "security check", "consent required",
)
PAGE_TYPES = ("text/html", "application/xhtml+xml")


def quality_status(fetched: Column, title: Column, text: Column, least_chars: int = 600, least_letters: int = 300) -> Column:
    """The first gate a page fails, or usable, of the gates that need nothing but its title and text; ``page_status`` has all."""
    size, letters, broken = F.char_length(text), alphabetic(text), F.char_length(text) - F.char_length(F.replace(text, F.lit("�"), F.lit("")))
    wrong = F.lit(False)
    for phrase in ERROR_TITLES:
        wrong = wrong | F.contains(F.lower(title), F.lit(phrase))
    return (
        F.when(~fetched, "not fetched").when(F.coalesce(wrong, F.lit(False)), "error title").when(text.isNull() | (F.trim(text) == ""), "no body")
        .when((size < least_chars) | (letters < least_letters), "short").when((sentence_marks(text) < 3) & (paragraphs(text) < 3), "no structure")
        .when(broken > F.greatest(F.lit(2.0), size * 0.005), "broken characters").otherwise("usable")
    )


def page_status(
    read: Column, content_type: Column, decoded: Column, home_redirect: Column, has_article: Column, score: Column, margin: Column, margin_per_letter: Column, agreement: Column, html_disagrees: Column,
    least_agreement: float = 0.8, least_margin: float = 0.02,
) -> Column:
    """The first gate of the whole cascade a page fails, or usable; ``read`` is its ``quality_status``.

    Unknown is not passed: without a content type, decoded bytes, an article mark or a finite score a page stops there.
    """
    of_type = F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(*PAGE_TYPES)
    fails = lambda gate: ~F.coalesce(gate, F.lit(False))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return (
        F.when(read == "not fetched", read).when(fails(of_type), "content type").when(fails(decoded), "not decoded").when(read == "error title", read).when(F.coalesce(home_redirect, F.lit(False)), "home page redirect")
        .when(read.isin("no body", "short", "no structure"), read).when(fails(has_article), "no article mark").when(read == "broken characters", read)
        .when(~finite(score) | ~finite(margin), "score not finite").when(fails(agreement >= least_agreement), "chunks disagree").when(fails(margin_per_letter >= least_margin), "low margin")
        .when(F.coalesce(html_disagrees, F.lit(False)), "html and model disagree").otherwise("usable")
    )


_UNUSABLE = ("und", "unk", "xxx", "zxx")


def original_language(info: Column) -> tuple[Column, Column]:
    """Language and status of a ``srclc:xxx;…`` field: only explicit source codes count, and they must agree."""
    pairs = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda x: F.startswith(F.trim(x), F.lit("srclc:")))
    codes = F.array_distinct(F.transform(pairs, lambda x: F.lower(F.trim(F.regexp_replace(F.trim(x), "^srclc:", "")))))
    code = F.get(codes, F.lit(0))
    good = code.rlike(r"^[a-z]{3}$") & ~code.isin(*_UNUSABLE)
    status = F.when(F.size(codes) == 0, "missing").when(F.size(codes) > 1, "conflicting").when(good, "explicit").otherwise("unusable")
    return F.when(status == "explicit", code), status


def info_map(info: Column) -> Column:
    """All ``name:value`` entries, the last of a name."""
    entries = F.filter(F.split(info, ";"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(entries, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return last


ALIASES = {"eng": "en", "spa": "es", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "rus": "ru", "zho": "zh", "chi": "zh"}


def html_language(html: Column) -> Column:
    """Primary subtag of the html element's lang, three-letter codes mapped, undetermined ones null."""
    tag = F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when((tag != "") & ~tag.isin("und", "unk", "zxx"), F.coalesce(names[tag], tag))


def html_title(html: Column) -> Column:
    title = collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    return F.nullif(title, F.lit(""))


def strict_utc_second(value: Column) -> Column:
    """Second of an ISO time that states Z or a colon offset; null for days, zone-less times and other offsets."""
    form = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
    whole = F.regexp_replace(value, r"^(.{16})(Z|[+-]\d{2}:\d{2})$", "$1:00$2")
    return F.unix_seconds(F.try_to_timestamp(F.when(value.rlike(form), whole)))
