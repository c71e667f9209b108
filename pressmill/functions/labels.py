"""What a language label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and codes of the six languages; a region or script may follow after '-' or '_'.
LABELS = {
    "english": "en eng english inglés anglais englisch",
    "spanish": "es spa spanish español espanol castellano castilian",
    "german": "de deu ger german deutsch",
    "french": "fr fra fre french français francais",
    "russian": "ru rus russian русский",
    "chinese": "zh zho chi cmn chinese mandarin 中文 汉语 简体中文",
}
# Labels that name no language.
NO_LANGUAGE = ("", "-", "?", "mis", "mul", "n/a", "na", "none", "null", "und", "unk", "unknown", "xxx", "zxx")


def label_language(label: Column) -> Column:
    """The language a label names, ``other`` for a name outside the six, null if it names none."""
    names = {n: lang for lang, ns in LABELS.items() for n in ns.split()}
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    low = F.lower(F.trim(label))
    known = F.coalesce(pairs[low], pairs[F.regexp_extract(low, r"^([\p{L}]{2,3})[-_]", 1)])
    none = low.isin(*NO_LANGUAGE)
    return F.when(low.isNull() | none, None).otherwise(F.coalesce(known, F.when(low.rlike(r"^\p{L}{2,}"), F.lit("other"))))
