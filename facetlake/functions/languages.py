"""L1: language names and codes normalised against a reference list."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from facetlake.functions.text import strip
from facetlake.functions.paths import evaluate_once, none_if_empty

# Fixed values, ISO 639: code of three letters, of two letters, bibliographic code, English name.
LANGUAGES: tuple[tuple[str, str, str, str], ...] = (
    ("afr", "af", "", "Afrikaans"),
    ("amh", "am", "", "Amharic"),
    ("ara", "ar", "", "Arabic"),
    ("aze", "az", "", "Azerbaijani"),
    ("bel", "be", "", "Belarusian"),
    ("ben", "bn", "", "Bengali"),
    ("bod", "bo", "tib", "Tibetan"),
    ("bos", "bs", "", "Bosnian"),
    ("bre", "br", "", "Breton"),
    ("bul", "bg", "", "Bulgarian"),
    ("cat", "ca", "", "Catalan"),
    ("ces", "cs", "cze", "Czech"),
    ("cym", "cy", "wel", "Welsh"),
    ("dan", "da", "", "Danish"),
    ("deu", "de", "ger", "German"),
    ("ell", "el", "gre", "Modern Greek (1453-)"),
    ("eng", "en", "", "English"),
    ("epo", "eo", "", "Esperanto"),
    ("est", "et", "", "Estonian"),
    ("eus", "eu", "baq", "Basque"),
    ("fas", "fa", "per", "Persian"),
    ("fin", "fi", "", "Finnish"),
    ("fra", "fr", "fre", "French"),
    ("gle", "ga", "", "Irish"),
    ("glg", "gl", "", "Galician"),
    ("grc", "", "", "Ancient Greek (to 1453)"),
    ("guj", "gu", "", "Gujarati"),
    ("hat", "ht", "", "Haitian"),
    ("hau", "ha", "", "Hausa"),
    ("heb", "he", "", "Hebrew"),
    ("hin", "hi", "", "Hindi"),
    ("hrv", "hr", "", "Croatian"),
    ("hun", "hu", "", "Hungarian"),
    ("hye", "hy", "arm", "Armenian"),
    ("ind", "id", "", "Indonesian"),
    ("isl", "is", "ice", "Icelandic"),
    ("ita", "it", "", "Italian"),
    ("jpn", "ja", "", "Japanese"),
    ("kan", "kn", "", "Kannada"),
    ("kat", "ka", "geo", "Georgian"),
    ("kaz", "kk", "", "Kazakh"),
    ("khm", "km", "", "Khmer"),
    ("kor", "ko", "", "Korean"),
    ("lao", "lo", "", "Lao"),
    ("lat", "la", "", "Latin"),
    ("lav", "lv", "", "Latvian"),
    ("lit", "lt", "", "Lithuanian"),
    ("mal", "ml", "", "Malayalam"),
    ("mar", "mr", "", "Marathi"),
    ("mkd", "mk", "mac", "Macedonian"),
    ("mon", "mn", "", "Mongolian"),
    ("msa", "ms", "may", "Malay (macrolanguage)"),
    ("mya", "my", "bur", "Burmese"),
    ("nep", "ne", "", "Nepali (macrolanguage)"),
    ("nld", "nl", "dut", "Dutch"),
    ("nor", "no", "", "Norwegian"),
    ("pan", "pa", "", "Panjabi"),
    ("pol", "pl", "", "Polish"),
    ("por", "pt", "", "Portuguese"),
    ("ron", "ro", "rum", "Romanian"),
    ("rus", "ru", "", "Russian"),
    ("san", "sa", "", "Sanskrit"),
    ("sin", "si", "", "Sinhala"),
    ("slk", "sk", "slo", "Slovak"),
    ("slv", "sl", "", "Slovenian"),
    ("som", "so", "", "Somali"),
    ("spa", "es", "", "Spanish"),
    ("sqi", "sq", "alb", "Albanian"),
    ("srp", "sr", "", "Serbian"),
    ("swa", "sw", "", "Swahili (macrolanguage)"),
    ("swe", "sv", "", "Swedish"),
    ("tam", "ta", "", "Tamil"),
    ("tel", "te", "", "Telugu"),
    ("tha", "th", "", "Thai"),
    ("tur", "tr", "", "Turkish"),
    ("ukr", "uk", "", "Ukrainian"),
    ("urd", "ur", "", "Urdu"),
    ("uzb", "uz", "", "Uzbek"),
    ("vie", "vi", "", "Vietnamese"),
    ("yid", "yi", "", "Yiddish"),
    ("zho", "zh", "chi", "Chinese"),
    ("zul", "zu", "", "Zulu"),
)
# Fixed values, ISO 639-2: bibliographic codes that differ from the terminological ones.
BIBLIOGRAPHIC = {
    "bod": "tib", "ces": "cze", "cym": "wel", "deu": "ger", "ell": "gre", "eus": "baq",
    "fas": "per", "fra": "fre", "hye": "arm", "isl": "ice", "kat": "geo", "mkd": "mac",
    "mri": "mao", "msa": "may", "mya": "bur", "nld": "dut", "ron": "rum", "slk": "slo",
    "sqi": "alb", "zho": "chi",
}

LANGUAGE_TYPE = "array<struct<value:string,label:string>>"


def runtime_languages(spark: SparkSession) -> tuple[tuple[str, str, str, str], ...]:
    """All languages that the Java runtime can name in English, as rows like ``LANGUAGES``.

    These are every two-letter code of ISO 639-1 and the three-letter codes of ISO 639-2 and
    639-3 in the runtime's locale data. Codes beyond those must be supplied by the caller.
    """
    locale = spark._jvm.java.util.Locale
    english, letters = locale.ENGLISH, "abcdefghijklmnopqrstuvwxyz"
    found: dict[str, tuple[str, str, str, str]] = {}
    for two in sorted(locale.getISOLanguages()):
        named = locale(two, "")
        three = named.getISO3Language()
        found[three] = (three, two, BIBLIOGRAPHIC.get(three, ""),
                        named.getDisplayLanguage(english))
    for three in map("".join, itertools.product(letters, repeat=3)):
        name = locale(three, "").getDisplayLanguage(english)
        if name != three and three not in found and three not in BIBLIOGRAPHIC.values():
            found[three] = (three, "", "", name)
    return tuple(found[k] for k in sorted(found))


_KNOWN: dict[str, tuple[tuple[str, str, str, str], ...]] = {}


def known_languages(spark: SparkSession) -> tuple[tuple[str, str, str, str], ...]:
    """``LANGUAGES`` and what else the runtime can name, looked up once per application."""
    key = spark.sparkContext.applicationId
    if key not in _KNOWN:
        own = {row[0] for row in LANGUAGES}
        _KNOWN[key] = (
            *(row for row in runtime_languages(spark) if row[0] not in own), *LANGUAGES)
    return _KNOWN[key]


def title_case(c: Column) -> Column:
    """Every run of letters capitalised."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _lookup(entries: list[tuple[str, str, str]]) -> Column:
    """A constant map from key to code and name, kept together by a control character."""
    text = "\x1d".join(f"{key}\x1f{code}\x1e{name}" for key, code, name in entries)
    return F.str_to_map(F.lit(text), F.lit("\x1d"), F.lit("\x1f"))


def _pair(found: Column) -> Column:
    return evaluate_once(
        F.split(found, "\x1e", 2),
        lambda parts: F.when(parts.isNotNull(), F.struct(
            F.get(parts, F.lit(0)).alias("value"), F.get(parts, F.lit(1)).alias("label")
        )),
    )


def normalize_language(
    c: Column,
    separator: str = ";",
    normalize: bool = True,
    allow_invalid: bool = True,
    normalize_invalid=title_case,
    languages: Sequence[tuple[str, str, str, str]] = LANGUAGES,
    translations: dict[str, str] | None = None,
) -> Column:
    """Distinct (code, name) pairs of a language field in order of appearance, else NULL.

    ``separator`` is a pattern. A known value gets its three-letter code; an unknown one its
    lower-case form, or is dropped. ``translations`` maps English names to display names. The
    reference list is a constant of fixed size, so it travels inside the expression.
    """
    pieces = F.split(F.coalesce(c, F.lit("")), separator, -1)
    if not normalize:
        kept = F.filter(pieces, lambda v: v != "")
        pairs = F.transform(
            kept, lambda v: F.struct(strip(v).alias("value"), strip(v).alias("label"))
        )
        pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    else:
        names = translations or {}
        by_code3 = {row[0]: row for row in languages}
        by_code3.update({row[2]: row for row in languages if row[2] and row[2] not in by_code3})
        tables = [
            _lookup([(key, row[0], names.get(row[3], row[3])) for key, row in source.items()])
            for source in (
                by_code3,
                {row[1]: row for row in languages if row[1]},
                {row[3].lower(): row for row in languages},
            )
        ]

        def resolve(value: Column) -> Column:
            code = F.lower(F.regexp_extract(value, r"^[^-_]*", 0))
            known = _pair(
                F.when(F.length(code) == 3, F.try_element_at(tables[0], code))
                .when(F.length(code) == 2, F.try_element_at(tables[1], code))
                .otherwise(F.try_element_at(tables[2], F.lower(value)))
            )
            if not allow_invalid:
                return known
            unknown = F.when(
                value != "",
                F.struct(F.lower(value).alias("value"), normalize_invalid(value).alias("label")),
            )
            return F.coalesce(known, unknown)

        trimmed = F.transform(pieces, lambda v: strip(v))
        pairs = F.filter(F.transform(trimmed, resolve), lambda p: p.isNotNull())
    return none_if_empty(F.array_distinct(pairs))
