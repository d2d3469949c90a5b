"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical base is one ASCII letter."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def replace_words(text: Column, words: dict[str, str]) -> Column:
    """Whole words replaced, one after the other."""
    for word, other in words.items():
        text = F.regexp_replace(text, rf"\b{word}\b", other)
    return text


def institution(text: Column, brackets: bool = False) -> Column:
    """A school's or firm's name as a key: lower case, no accents, bracketed
    text (unless ``brackets``), apostrophes or dots, ``and`` spelt out, other
    marks as spaces."""
    out = strip_accents(F.lower(text))
    if not brackets:
        out = F.regexp_replace(out, r"\s*\([^)]*\)\s*|\s*\[[^\]]*\]\s*", " ")
    out = F.regexp_replace(out, r"['.]", "")
    out = F.regexp_replace(out, r"[&+]", " and ")
    return squeeze(F.regexp_replace(out, r"[^a-z0-9 ]+", " "))


#: Short forms in names of fields of study, and what is dropped.
FIELD_FORMS = {
    "engineering": ("engrg", "engr", "engineeri"), "computer": ("compu", "comp", "compute"), "electrical": ("elec", "elecs"), "science": ("sci",),
    "information": ("info",), "systems": ("sys", "syss"), "technology": ("tec", "techno", "tech"), "mechanical": ("mech",),
}
FIELD_DROPPED = (r"m\s?a", r"m\s?s", r"b\s?s", r"b\s?a", "[0-9]+", r"m\s?d", r"p\s?h\s?d", "bachelor", "bachelors", "master", "masters", "in", "and", r"j\s?d", "degree")


def field_of_study(text: Column) -> Column:
    """A field's name as a key: lower case, no accents, apostrophes or dots,
    ``and`` spelt out, other marks but slashes as spaces; short forms spelt
    out, degree words and numbers dropped. A form takes the spaces beside it,
    so of two that touch the first alone is seen."""
    out = F.regexp_replace(strip_accents(F.lower(text)), r"['’.]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s?(&|\+)\s?", " and "), r"[^A-z0-9/\s]", " ")
    for word, forms in (*FIELD_FORMS.items(), ("", FIELD_DROPPED)):
        out = F.regexp_replace(out, rf"(^|\s)({'|'.join(forms)})($|\s)", f" {word} " if word else " ")
    return squeeze(out)


#: Legal forms of companies.
LEGAL_FORMS = ("incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "llp", "lp", "plc", "gmbh", "ag", "sa", "pvt")


def company(text: Column) -> Column:
    """A company's name as a key: legal forms go, wherever they stand."""
    out = F.regexp_replace(institution(text), r"\b(" + "|".join(LEGAL_FORMS) + r")\b", " ")
    return squeeze(F.regexp_replace(out, r"^the\b", ""))


def company_stem(text: Column, rounds: int = 3) -> Column:
    """As ``company``, but legal forms go from the end only, one by one."""
    out = institution(text)
    for _ in range(rounds):
        out = F.regexp_replace(out, r"\s(" + "|".join(LEGAL_FORMS) + r")$", "")
    return out


def full_name(text: Column) -> Column:
    """A person's name: what follows a comma, bracketed text, credentials and
    middle initials go."""
    out = F.regexp_replace(F.split(text, ",")[0], r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"(?i)\b(ph\.?d|m\.?d|mba|jr|sr|ii|iii)\b\.?", " ")
    out = F.regexp_replace(out, r"\s[A-Za-z]\.?(?=\s)", " ")
    return F.lower(squeeze(out))


def title_case(text: Column) -> Column:
    """Upper case after any character that isn't a letter, as Python has it;
    initcap keeps letters after an apostrophe or hyphen small."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.str.title()

    return F.pandas_udf(run, "string")(text)


def zip5(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d{3,5})", 1)
    return F.when(found != "", F.lpad(found, 5, "0"))


#: Ordered rules for kinds of degree, each with the texts (a
#: school's, a degree's, a field's; in lower case where ``low``) and the
#: pattern that is looked for. The first kind that fits counts.
SHORT_COURSES = "edx|course|credential|semester|exchange|abroad|summer|internship|certificat|coursera|udemy"
DEGREE_RULES = (
    ("High School", (("low school", r"high\s?school"), ("low degree", r"high\s?school"), ("low field", r"high\s?school"), ("low degree", r"^g\.?e\.?d\.?$"))),
    ("Non-Degree", (("low degree", "cert|credential|course|semester|exchange|abroad|summer|internship|edx|cdl|coursera|udemy"), ("low school", SHORT_COURSES), ("low field", SHORT_COURSES))),
    ("Bachelor", (
        ("low degree", "undergrad"), ("degree", r"\b(B\.?A\.?|B\.?S\.?C\.?E\.?|B\.?Sc\.?|B\.?A\.?E\.?|B\.?Eng\.?|A\.?B\.?|S\.?B\.?|B\.?B\.?M\.?|B\.?I\.?S\.?)\b"),
        ("degree", r"^B\.?\s?S\.?"), ("low field", "bachelor"), ("low degree", "bachelor|baccalauréat"),
    )),
    ("Master", (("low degree", "master"), ("degree", r"^M\.?(Eng|Sc|A)\.?"), ("degree", r"M\.?S\.?C\.?E\.?|M\.?P\.?A\.?|M\.?Eng|M\.?Sc|M\.?A"), ("low field", "master"))),
    ("Associate", (("low field", "associate"), ("degree", r"^A\.?\s?A\.?"), ("low degree", "associate"))),
    ("Doctor", (("low degree", r"doctor|ph\.?\s?d\.?|d\.?o\.?|dvm|jd"), ("degree", r"Ph\.?D\.?|D\.?O\.?|J\.?D\.?"))),
    ("High School", (("school", r"(HS| High| HIGH| high|H\.S\.|S\.?S\.?C|H\.?S\.?C\.?|I\.?B\.?)$"),)),
    ("Bachelor", (("degree", r"^B\.?\s?[A-Z]"),)),
    ("Master", (("degree", r"^M\.?\s?[A-Z]"),)),
)
#: What makes a field STEM, what makes a science not, and what
#: makes a field something else.
STEM_FIELDS = ("Engineering", "Biology", "Statistics", "Chemistry", "Medicine", "Mathematics", "Physics", "Information Technology")
OTHER_FIELDS = ("Nursing", "Marketing", "Law", "Economics", "Finance", "Accounting", "Business", "Education", "Architecture")
STEM_WORDS = (
    "engineer|information|math|chem|bio|pharm|psych|geography|environment|animation|cyber|comput|intelligence|data|aero|technol|software|web.*dev|energy|astronomy|"
    "robotics|hardware|machine learning|deep learning|nuclear|materials|earth|bsee|msee|game.*design|electr"
)
SOFT_SCIENCE = "(political|social|exercise|arts and|nursing|police) science"
OTHER_WORDS = (
    "studies|design|government|humanities|journalism|english|language|administration|history|advertising|education|marketing|nursing|law|economics|finance|accounting|"
    "architecture|linguistics|communication|theater|theatre|fashion|philosophy|politic|international|public|global|photography|sociology|religion|theology|dance|music|"
    "drama|writing|therapy|media|art|exercise|business|commerce|film|liberal|esthetic|anthropology|criminal|social|sales|health"
)


def degree_kind(school: Column, degree: Column, field: Column) -> Column:
    """The kind of a degree by the first rule that fits; 'Missing' if none
    does. Null texts fit nothing."""
    texts = {"school": school, "degree": degree, "field": field}
    texts |= {f"low {k}": F.lower(v) for k, v in texts.items()}
    out = F.lit("Missing")
    for kind, tests in reversed(DEGREE_RULES):
        fits = F.lit(False)
        for name, pattern in tests:
            fits = fits | F.coalesce(texts[name].rlike(pattern), F.lit(False))
        out = F.when(fits, kind).otherwise(out)
    return out


def stem_flag(field: Column, raw_field: Column, raw_degree: Column) -> Column:
    """1 for STEM, 0 for other fields, null where nothing tells."""
    has = lambda c, p: F.coalesce(F.lower(c).rlike(p), F.lit(False))
    named = lambda names: F.coalesce(field.isin(*names), F.lit(False))
    stem = named(STEM_FIELDS) | has(raw_field, STEM_WORDS) | has(raw_degree, STEM_WORDS) | (has(raw_field, "science") & ~has(raw_field, SOFT_SCIENCE))
    return F.when(stem, 1).when(named(OTHER_FIELDS) | has(raw_field, OTHER_WORDS), 0)


def cip4(code: Column) -> Column:
    digits = F.regexp_replace(code.cast("string"), r"[^0-9]", "")
    return F.substring(digits, 1, 4).try_cast("int")


def words(text: Column) -> Column:
    """The words of a text, in order; no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by spaces; none from a shorter list."""
    last = F.size(tokens) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def relation(left: Column, right: Column) -> Column:
    """2 for equal texts, 1 where one's words contain the other's, else 0."""
    a, b = words(left), words(right)
    within = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(left == right, 2).when(within & some, 1).otherwise(0)


def correct_words(df: DataFrame, key: str, text: str, fixes: DataFrame) -> DataFrame:
    """``key, corrected``: words found in ``fixes`` (word, fixed) replaced,
    the others kept, in order. ``fixes`` has a word once."""
    tokens = df.select(key, F.posexplode(words(F.col(text))).alias("_at", "_word"))
    fixed = tokens.join(fixes, F.col("_word") == F.col("word"), "left")
    fixed = fixed.select(key, F.struct("_at", F.coalesce("fixed", "_word").alias("w")).alias("_t"))
    out = fixed.groupBy(key).agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    return out.select(key, F.array_join(F.transform("_ts", lambda t: t["w"]), " ").alias("corrected"))


def replace_first(text: Column, pattern: str, other: str) -> Column:
    """The first match replaced, the others left: what a replace does where
    all matches aren't asked for. ``pattern`` must have no groups."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", "$1" + other.replace("\\", "\\\\").replace("$", "\\$"))
