"""Numbers, descriptions, codes, names and tokens out of raw cell text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit forms, noise and letter folding of the cell texts.
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹$€£¥%", "01234567890123456789")
NO_NUMBER = r"(?i)^#|^-$|^nil$|^null$|rate only|سعر فقط|محمل|included"
CURRENCY_WORDS = r"(?i)EGP|USD|EUR|LE|L\.E\.|ج\.م|ريال|درهم"
MARKS = "[ً-ٟـٰ]"
FOLD = ("أإآٱةى", "ااااهي")
ORDINALS = [("1", "الأول|الاول"), ("2", "الثاني|الثانى"), ("3", "الثالث"), ("4", "الرابع"), ("5", "الخامس"), ("6", "السادس"), ("7", "السابع"), ("8", "الثامن"), ("9", "التاسع"), ("10", "العاشر")]
BILL_WORD = r"(?i)(?:Bill|Schedule|Package|الباب|جدول)\s*([0-9]+(?:\.[0-9]+)?[a-zA-Z]*|[a-zA-Z][0-9]+)"
BILL_WORD_PLAIN = r"(?i)(?:Bill|Schedule|Package|الباب|جدول)\s*([0-9]+[a-zA-Z]*|[a-zA-Z][0-9]+)"
BILL_FIRST = r"^\s*([0-9]+(?:\.[0-9]+)?[a-zA-Z]?|[a-zA-Z][0-9]+)\b"
NAME_NOISE = ["bill", "schedule", "package", "trade", "no", "الباب", "باب", "جدول", "قسم", "أعمال", ".", "-", "_"]
TAG_ORDINALS = [("الأول|الاول|اول", "1"), ("الثاني|الثانى|ثاني|ثانى", "2"), ("الثالث|ثالث", "3"), ("الرابع|رابع", "4"), ("الخامس|خامس", "5"), ("السادس|سادس", "6"), ("السابع|سابع", "7"), ("الثامن|ثامن", "8"), ("التاسع|تاسع", "9"), ("العاشر|عاشر", "10")]
TAG_BILL, TAG_DIGITS = r"(?:bill|الباب|جدول)(\d+[a-z]*)", r"(\d+[a-z]*)"
TAG_WORDS = ["infra", "retail", "landscape", "prelim", "common", "mep", "facade", "hvac", "plumb", "خرسان", "حفر", "كهرباء", "صحي", "ميكانيك"]
DELIMITERS = r"[\s,;:/\\()\[\]{}.\-_+*&|\"'،؛]+"


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def parse_decimal(raw: Column) -> Column:
    """NR1: a number out of a cell; 0 where the cell says there is none or cannot be read."""
    s = F.trim(blank(raw))
    t = F.trim(F.regexp_replace(F.translate(s, *DIGITS), CURRENCY_WORDS, ""))
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    decimal_comma = (~t.contains(".")) & (commas == 1) & ((F.length(t) - F.instr(t, ",") != 3) | t.startswith("0"))
    t = F.when(decimal_comma, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return F.when((s == "") | s.rlike(NO_NUMBER), F.lit(0).cast("decimal(28,8)")).otherwise(F.coalesce(t.try_cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)")))


def parse_positive(raw: Column) -> Column:
    """NR2: the stricter profile parse; null unless above 0.00001."""
    t = F.trim(F.regexp_replace(F.trim(blank(raw)), r"(?i)[,$£€]|EGP", ""))
    v = F.when(~t.rlike("[^0-9eE.+-]"), t.try_cast("decimal(28,8)"))  # only plain digits count here
    return F.when(v > F.lit("0.00001").cast("decimal(28,8)"), v)


def normalise_description(x: Column) -> Column:
    """NR4: marks dropped, letters folded, punctuation deleted, spaces collapsed."""
    t = F.translate(F.regexp_replace(blank(x), MARKS, ""), *FOLD)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{Nd}\s]", ""), r"\s+", " "))


def let(x: Column, f) -> Column:
    """f of x, where f uses x several times: x is worked out once a row, and the expression stays small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clean_normalise(x: Column) -> Column:
    """NR5: runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(blank(x)), r"[^\p{L}\p{Nd}]+", " "))


def _extract(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def bill_code(sheet: Column, is_bill: Column, decimals: bool = True) -> Column:
    """NR9 (decimals) and NR10: code of a sheet name, '-' for none."""
    s = blank(sheet)
    prefix = F.trim(F.substring_index(s, "-", 1))
    found = F.coalesce(
        _extract(s, BILL_WORD if decimals else BILL_WORD_PLAIN),
        _extract(s, BILL_FIRST),
        F.when((F.instr(s, "-") > 1) & (F.length(prefix) <= 6) & prefix.rlike("[0-9]"), prefix),
        *([F.when(s.rlike(p), F.lit(n)) for n, p in ORDINALS] if decimals else []),
    )
    return F.when(is_bill & (F.trim(s) != ""), F.coalesce(F.upper(found), F.lit("-"))).otherwise("-")


def normalise_name(x: Column) -> Column:
    """NR11: sheet name without its noise words, wherever they stand."""
    t = F.lower(blank(x))
    for w in NAME_NOISE:
        t = F.replace(t, F.lit(w), F.lit(""))
    return F.trim(t)


def bill_key(x: Column) -> Column:
    """NR14."""
    return F.regexp_replace(F.lower(blank(x)), r"[^\p{L}\p{Nd}]", "")


def bill_tag(key: Column) -> Column:
    """NR15: number of a bill key without leading zeros, else its first trade word, else ''."""
    t = blank(key)
    for p, n in TAG_ORDINALS:
        t = F.regexp_replace(t, p, n)

    def tag(t: Column) -> Column:
        number = F.coalesce(_extract(t, TAG_BILL), F.when(F.length(F.regexp_extract(t, TAG_DIGITS, 1)) >= 2, F.regexp_extract(t, TAG_DIGITS, 1)))
        word = F.coalesce(*[F.when(t.contains(w), F.lit(w)) for w in TAG_WORDS], F.lit(""))
        return F.coalesce(F.regexp_replace(number, "^0+", ""), word)

    return let(t, tag)


def clean_code(x: Column) -> Column:
    """NR16."""
    # one letter stays one letter: a rune without case stands in for the sharp s, whose capital is two
    return F.translate(F.regexp_replace(F.upper(F.translate(blank(x), "ß", "ᚠ")), r"[^\p{L}\p{Nd}]", ""), "ᚠ", "ß")


def plain_tokens(x: Column) -> Column:
    """NR17: distinct sorted alphanumeric runs longer than two, without the Arabic article."""
    runs = F.filter(F.split(F.lower(blank(x)), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) > 2)
    return F.array_sort(F.array_distinct(F.transform(runs, lambda w: F.when((F.length(w) >= 4) & w.startswith("ال"), F.substring(w, 3, 1 << 20)).otherwise(w))))


def _without_article(w: Column) -> Column:
    n = F.length(w)
    return F.when(n < 4, w).when(w.startswith("ال"), F.regexp_replace(w, "^ال", "")).when((n >= 5) & w.rlike("^(وال|بال)"), F.regexp_replace(w, "^(وال|بال)", "")).when((n >= 5) & w.startswith("لل"), F.regexp_replace(w, "^لل", "")).otherwise(w)


def _without_ending(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ing"), F.regexp_replace(w, "ing$", ""))
        .when((n > 6) & w.endswith("ation"), F.regexp_replace(w, "ation$", ""))
        .when((n > 5) & w.endswith("ed"), F.regexp_replace(w, "ed$", ""))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def stemmed_tokens(x: Column) -> Column:
    """NR18: distinct sorted stems; ``16mm`` counts as ``16`` and ``mm``."""
    t = F.translate(F.regexp_replace(F.lower(blank(x)), MARKS, ""), "أإآةى", "اااهي")
    parts = F.split(F.regexp_replace(t, r"(\p{Nd})(\p{L})", "$1 $2"), DELIMITERS)
    return F.array_sort(F.array_distinct(F.transform(F.transform(F.filter(parts, lambda w: F.length(w) >= 2), _without_article), _without_ending)))


def jaccard(a: Column, b: Column) -> Column:
    """ST4: shared over all tokens; 0 where both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def coverage(a: Column, b: Column) -> Column:
    """ST4: shared over the smaller set."""
    m = F.least(F.size(a), F.size(b))
    return F.when(m > 0, F.size(F.array_intersect(a, b)) / m).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """ST4: set cosine."""
    p = F.size(a) * F.size(b)
    return F.when(p > 0, F.size(F.array_intersect(a, b)) / F.sqrt(p)).otherwise(F.lit(0.0))


def lev_similarity(a: Column, b: Column) -> Column:
    """ST5: 1 - distance / longer length; 0 for two blank texts, which say nothing."""
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m > 0, 1 - F.levenshtein(a, b) / m).otherwise(F.lit(0.0))


def column_letter(n: Column) -> Column:
    """NR32: 1 -> A, 27 -> AA (up to 702)."""
    return F.concat(F.when(n > 26, F.char(F.lit(64) + F.floor((n - 1) / 26).cast("int"))).otherwise(""), F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)).cast("int")))


def natural_key(x: Column) -> Column:
    """NR33: digit runs padded to six."""
    parts = F.regexp_extract_all(blank(x), F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 6, "0")).otherwise(p)), "")


def token_hash(token: Column) -> Column:
    """NR19: 64-bit hash of a token, lower-cased; only equality of hashes has meaning."""
    return F.xxhash64(F.lower(token))


def file_size(size: Column) -> Column:
    """NR36: bytes, whole KB or MB with one decimal; a half goes to the even digit, as quotients by powers of two are exact."""
    b = size.cast("double")
    mb = F.format_string("%.1f MB", F.rint(b * 10 / (1 << 20)) / 10)
    return F.when(size >= 1 << 20, mb).when(size >= 1 << 10, F.format_string("%.0f KB", F.rint(b / 1024))).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def role_badge(role: Column, priced: Column) -> Column:
    """NR36: the shown name of a file's role."""
    # fixed values
    target = F.when(priced, "جدول الاستشاري المستهدف (Target)").otherwise("جدول استشاري غير مسعر (Target)")
    return F.when(role == "ContractorPriced", "ملف المقاول المسعر (Source)").when(role == "ConsultantTarget", target).when(role == "SupplementaryRates", "ملف أسعار إضافي / موردين (Rates)").otherwise("ملف مرجعي")
