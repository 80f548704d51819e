"""Text functions on columns; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Letters and digits around which a keyword is no whole word.
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Keyword patterns of the clause classes.
CLAUSE_PATTERNS = {
    "emissions": r"emissions?|ghg|greenhouse\s+gas(?:es)?|co2|co₂|carbon|scope\s*[123]|tco2e|ch4|methane",
    "water": r"water|withdrawal|discharge|wastewater|effluent|consumption|irrigation",
    "waste": r"waste|recycl(?:e|ing)|landfill|hazardous|incineration|solid\s+waste",
    "energy": r"energy|electricity|kwh|mwh|renewable|solar|wind|efficien(?:t|cy)",
}
# Abbreviations that end no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "mr.", "mrs.", "dr.", "vs.", "u.s.", "u.k.", "etc.")


def normalize_ws(x: Column) -> Column:
    """Runs of any Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def word_count(x: Column) -> Column:
    """Tokens between white space; empty and null have none."""
    flat = normalize_ws(F.coalesce(x, F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " ")))


def arabic_share(x: Column) -> Column:
    """Share of characters in the Arabic block."""
    return F.length(F.regexp_replace(x, "[^؀-ۿ]", "")) / F.greatest(F.length(x), F.lit(1))


def detect_lang(x: Column, share: float = 0.10) -> Column:
    return F.when(arabic_share(x) >= share, "ar").otherwise("en")


def rag_tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def rag_sentences(x: Column) -> Column:
    """Sentences that end with . ! or ?, whatever follows."""
    return F.filter(F.transform(F.split(F.trim(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def sentences(x: Column) -> Column:
    """Sentences after . ! ? or their Arabic forms before a letter or digit, but for ends of abbreviations.

    Where a sentence goes on after an abbreviation its white space becomes single spaces.
    """
    joint, ahead = "\ue000", r"\s+(?=[A-Za-z0-9؀-ۿ])"
    short = "(?i)(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")"
    held = F.regexp_replace(F.trim(x), short + ahead, f"$1{joint}")
    parts = F.filter(F.transform(F.split(held, "(?<=[.!?؟۔])" + ahead), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.contains(joint), normalize_ws(F.translate(s, joint, " "))).otherwise(s))


def clause_classes(x: Column, patterns: dict[str, str] = CLAUSE_PATTERNS) -> Column:
    """The classes whose keywords a text has as whole words, in the order of patterns."""
    hits = [F.when(x.rlike(f"(?iU){EDGE_BEFORE}(?:{p}){EDGE_AFTER}"), F.lit(k)) for k, p in patterns.items()]
    return F.array_compact(F.array(*hits))


def smoothed_jaccard(a: Column, b: Column) -> Column:
    """(shared + 0.5) / (all + 0.5) of two token sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise((both + 0.5) / (either + 0.5))


def slug(x: Column, length: int = 48) -> Column:
    """Letters and digits with single dots between, at most so long."""
    dotted = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "."), r"^\.+|\.+$", "")
    return F.regexp_replace(F.substring(dotted, 1, length), r"\.+$", "")


def kwh_threshold(x: Column) -> Column:
    """The number of kWh that a comparison names, else any of 2 to 5 digits."""
    low = F.lower(x)
    named = F.regexp_extract(low, r"(?:[<>]=?|at\s+least|more\s+than|over)\s*(\d{2,5})\s*kwh", 1)
    plain = F.regexp_extract(low, r"(\d{2,5})\s*kwh", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(plain, F.lit(""))).cast("double")


def left(x: Column, n: int = 300) -> Column:
    return F.substring(x, 1, n)


def quoted(name: str, quote: str = "`") -> str:
    """An identifier between quotes; a quote within is doubled."""
    return quote + name.replace(quote, quote * 2) + quote


def latin1(x: Column) -> Column:
    """Text without the characters that Latin-1 lacks."""
    return F.regexp_replace(x, r"[^\x{00}-\x{FF}]", "")


def paired(a: Column, b: Column) -> Column:
    """Two arrays as one of pairs; null if they differ in length."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b))
