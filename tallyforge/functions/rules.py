"""Units, scopes, currencies and sheet rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let

# Unit spellings and their canonical form.
CANON = {
    "m2": ["m2", "sqm", "sq.m", "m²", "م2", "م²", "متر مربع", "متر2"],
    "m3": ["m3", "cum", "cu.m", "m³", "م3", "م³", "متر مكعب", "متر3"],
    "m": ["lm", "m", "lin.m", "mtr", "م.ط", "متر طولي", "متر"],
    "item": ["nr", "no", "nos", "item", "عدد", "بند", "حبة", "قطعة"],
    "ton": ["ton", "tonne", "tons", "طن"],
    "kg": ["kg", "kgs", "كجم", "كيلو", "كيلوجرام"],
    "sum": ["ls", "sum", "مقطوعية", "جملة", "مقطوع"],
}
# Unit groups that are compatible with each other.
GROUPS = {**CANON, "item": ["nr", "no", "nos", "number", "item", "عدد", "بند", "حبة", "قطعة"], "ton": ["t", "ton", "tonne", "tons", "طن"]}
KNOWN_UNITS = "m2 m3 lm m nr no nos item ton kg ls sum sqm cum lin.m mtr م2 م² م3 م³ م.ط متر عدد بند حبة قطعة طن كجم مقطوعية مقطوع جملة".split() + ["متر مربع", "متر مكعب", "متر طولي"]
# Dimension class of a unit (dots and spaces removed).
DIMENSIONS = {
    "Volume": "m3 cum m³ cubicmeter م3 مترمكعب لتر liter l",
    "Area": "m2 sqm m² sqmeter م2 مترمربع مسطح فدان",
    "Length": "m lm ml meter linm م مط مترطولي متر km mm cm inch",
    "Weight": "ton tonne طن kg كجم كيلوجرام gm lbs",
    "LumpSum": "ls sum item lot job مقطوعية بند جملة شامل",
    "Count": "no nr ea each pcs piece set عدد حبة قطعة طقم نقطة point unit وحدة",
    "Time": "month mo شهر day يوم week wk اسبوع hr hour ساعة",
    "Power": "kw kva hp mw حصان كيلووات",
}
# Scope phrases, in order of test.
DISMANTLE = ["dismantle", "dismantling", "demolish", "demolition", "removal of", "stripping out", "فك وإزالة", "فك و ازالة", "إزالة", "ازالة", "هدم", "تكسير", "خلع", "تخريد"]
MASK = [("power supply", "power_src"), ("power supplies", "power_src"), ("air supply", "air_src"), ("water supply", "water_src"), ("gas supply", "gas_src"), ("installation kit", "inst_kit"), ("installation manual", "inst_manual")]
SUPPLY_ONLY = ["supply only", "furnish only", "equipment only", "materials only", "delivery only", "procurement only", "توريد فقط", "شراء فقط", "تجهيز فقط", "مهمات فقط", "مواد فقط"]
INSTALL_ONLY = ["install only", "installation only", "erection only", "labor only", "labour only", "fixing only", "wiring only", "termination only", "تركيب فقط", "مصنعية فقط", "مصنعيات فقط", "تشغيل فقط", "تثبيت فقط", "توصيل فقط", "سحب فقط", "تمديد فقط"]
DUAL = [
    "supply and install", "supply & install", "supply and erect", "supply & erect", "supply, erect", "furnish and install", "furnish & install",
    "supply, install", "supply , install", "supply,install", "supply, test", "supply and test", "supply & test", "supply, deliver and install", "supply, delivery and installation", "complete in place",
    "توريد وتركيب", "توريد و تركيب", "توريد وتنفيذ", "توريد و تنفيذ", "توريد وتشغيل", "توريد و تشغيل", "توريد وبناء", "توريد و بناء", "توريد وتثبيت", "توريد و تثبيت", "توريد ومد", "توريد و مد", "توريد وسحب", "توريد و سحب",
    "بالمصنعية والتوريد", "شامل التوريد والتركيب", "شامل التوريد و التركيب",
]
SUPPLY = ["supply", "furnish", "procurement", "توريد", "شراء", "تجهيز", "تقديم"]
INSTALL = ["install", "erection", "fixing", "wiring", "termination", "pulling", "laying", "labor", "labour", "workmanship", "testing and commissioning", "testing & commissioning", "تركيب", "مصنعية", "مصنعيات", "تثبيت", "توصيل", "تمديد", "سحب كابلات", "سحب أسلاك", "إنهاء وتوصيل", "اختبار وتشغيل"]
# Multipliers of unlike scopes.
SCOPE_PENALTY = {("InstallOnly", "SupplyAndInstall"): 0.20, ("SupplyOnly", "SupplyAndInstall"): 0.50}
# Currency words in order of test, and rates against the base.
CURRENCIES = [("USD", "usd|dollar|دولار"), ("EUR", "eur|يورو"), ("EGP", r"egp|l\.e\.|ج\.م|جنيه|جنية"), ("SAR", "sar|ريال"), ("AED", "aed|درهم"), ("GBP", "gbp|استرليني|باوند"), ("KWD", "kwd|دينار")]
RATES = {"EGP": "1.00", "USD": "48.50", "EUR": "52.80", "SAR": "12.93", "AED": "13.20", "GBP": "61.50", "KWD": "158.00"}
FOREIGN = ["USD", "EUR", "SAR", "AED", "GBP", "KWD"]
DRIFT = 0.18
# Sheets that hold no bill.
BILL_START = "^(bill|schedule|package|الباب|جدول|قسم)"
GRAND = "grand summary|executive summary|الملخص العام|ملخص عام"
NON_BILL = "^(table of contents|preamble|schedule of insurance|instruction|grand summary|cover|dayworks|price analysis|audit|dashboard|executive|pricing_linkage|linkage|فهرس|غلاف|ملخص)|^summary$|^notes?$|grand summary|ملخص عام|الملخص العام|preamble|qty notes|ملاحظات"
NON_BILL_BROAD = "^(table of contents|preamble|schedule of insurance|instruction|grand summary|cover|dayworks|price analysis|audit|dashboard|executive|pricing_linkage|linkage)|summary|grand|contents|preamble|cover|notes|^note$|ملاحظات|toc|فهرس|غلاف|ملخص"
PIVOT = "row labels|تسميات الصفوف|^pivot ?table$|sum of |count of |average of |مجموع ال"
METADATA_CODE = "^(employer|project|tender no\\.?|tender title|boq description|tenderer name|vendor|client|owner|consultant|contractor|date|المالك|المشروع|الاستشاري|المقاول)$"
METADATA_TEXT = "^(employer|tender no)"
# Header patterns by role.
HEADERS = {
    "serial": r"^(sn|s\.n\.?|ser|no\.?|seq|م|مسلسل|تسلسل|م\.)$",
    "code": r"^(item\s*(no|code|#)?|item|code|ref|pos|line|رقم|كود|كود\s*البند|رقم\s*البند|بند)$",
    "hierarchy": r"^(level\s*\d+|division|package|boq\s*name|sub-?boq(\s*name)?|cat\.?|category|sub-?category|المرحلة|الباكج)$",
    "description": r"(description|particular|statement|scope|work|specification|details|item\s*desc|الوصف|البيان|تفاصيل|تفاصيل\s*البند|بيان\s*الأعمال|المواصفات)",
    "unit": r"(^|\b)(unit|uom|measure|u\.?o\.?m\.?|unit\s*of\s*measure|unité|الوحدة|وحدة\s*القياس|المقياس)($|\b)",
    "quantity": r"(quantity|qty|vol|volume|quantities|qte|quantité|الكمية|الكميات|إجمالي\s*الكمية)",
    "rate": r"(unit\s*rate|unit\s*price|rate|price|net\s*rate|tender\s*rate|p\.?u\.?|(^|\b)u\.?r\.?($|\b)|prix\s*unitaire|سعر\s*الوحدة|الفئة|فئة|السعر|سعر\s*البند|سعر\s*إفرادي|سعر\s*مفرد)",
    "composite": r"(total\s*(unit\s*)?rate|total\s*(unit\s*)?price|all-?in\s*(unit\s*)?rate|composite\s*rate|overall\s*rate|إجمالي\s*الفئة|إجمالي\s*سعر\s*الوحدة|فئة\s*شاملة|فئة\s*إجمالية|السعر\s*الإجمالي\s*للوحدة|سعر\s*شامل)",
    "partial": r"(supply\s*(rate|price)|install\s*(rate|price)|erection\s*(rate|price)|material\s*(rate|price)|labor\s*(rate|price)|سعر\s*التوريد|فئة\s*التوريد|سعر\s*التركيب|فئة\s*التركيب|سعر\s*المصنعية)",
    "amount": r"(total\s*amount|total\s*price|amount|total|net\s*amount|extended|montant|الإجمالي|المبلغ|القيمة|إجمالي\s*القيمة|جملة)",
    "bill": r"^(bill|bill\s*no\.?|trade|package|division|الباب|القسم|المرحلة|العقد|الباكج)$",
    "section": r"^(section|sub-?section|class|part|heading|عنصر|بند\s*رئيسي|مجموعة)$",
}
# Trades in order of test.
TRADES = [
    ("Preliminaries", "prelim|general requirement|insurance|شروط عامة"),
    ("Civil & Structural", "concrete|reinforcement|rebar|excavat|خرسان|حفر|ردم|حديد"),
    ("MEP Services", "mep|cable|panel|generator|chiller|pump|light|كابل|انارة|تكييف"),
    ("Infrastructure & Wet Networks", "infra|pipe|drain|sewer|water|network|شبك|مواسير"),
    ("Landscape & External Works", "landscap|plant|irrigation|golf|زراع|ري|مسطحات"),
    ("Architectural & Finishes", "finish|paint|plaster|tile|marble|masonry|بياض|دهان|سيراميك|مباني"),
]
OTHER_TRADE = "General & Miscellaneous"
# Words of file names that tell the role.
CONTRACTOR = "candy|ccs|priced|pricing|selling|vendor|supplier|subcon|quotation|offer|عرض سعر|تسعير|مسعر|مورد|مقاول"
UNPRICED = "unpriced|غير مسعر"
CONSULTANT = "consultant|tender|unpriced|client|owner|employer|engineer|طرح|استشاري|مناقصة|غير مسعر|مالك|عميل"


def _lookup(x: Column, table: dict[str, list[str]], default: Column) -> Column:
    return reduce(lambda acc, kv: F.when(x.isin(kv[1]), F.lit(kv[0])).otherwise(acc), reversed(table.items()), default)


def _low(x: Column) -> Column:
    return F.lower(F.trim(blank(x)))


def canonical_unit(x: Column) -> Column:
    """NR3."""
    return _lookup(_low(x), CANON, _low(x))


def known_unit(x: Column) -> Column:
    """NR8."""
    return _low(x).isin(KNOWN_UNITS)


def dimension(x: Column) -> Column:
    """NR22."""
    u = F.translate(_low(x), ". ", "")
    return _lookup(u, {k: v.split() for k, v in DIMENSIONS.items()}, F.lit("Unknown"))


def unit_score(a: Column, b: Column) -> Column:
    """NR23."""
    x, y, p, q = _low(a), _low(b), dimension(a), dimension(b)
    mixed = ((p == "Count") & (q == "LumpSum")) | ((p == "LumpSum") & (q == "Count"))
    return F.when((x == "") & (y == ""), 0.8).when((x == "") | (y == ""), 0.5).when(x == y, 1.0).when((p != "Unknown") & (p == q), 0.95).when(mixed, 0.85).otherwise(0.2)


def units_compatible(a: Column, b: Column) -> Column:
    """NR24: no unit goes with any."""
    x, y = F.lower(blank(a)), F.lower(blank(b))
    p, q = (let(u, lambda v: _lookup(v, GROUPS, F.lit(None).cast("string"))) for u in (x, y))
    return (x == y) | (x == "") | (y == "") | F.coalesce(p == q, F.lit(False))


def quantity_score(a: Column, b: Column) -> Column:
    """NR25, on doubles or decimals."""
    low, high = F.least(a, b).cast("double"), F.greatest(a, b).cast("double")
    rel = (high - low) / high
    near = F.when(F.abs(high / low - 1000) < 1, 0.95).when(rel <= 0.01, 0.98).when(rel <= 0.05, 0.85).when(rel <= 0.15, 0.70).otherwise(F.greatest(F.lit(0.1), 1 - rel))
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.4).when(a == b, 1.0).otherwise(near)


def _has(x: Column, words: list[str]) -> Column:
    return reduce(lambda p, w: p | x.contains(w), words[1:], x.contains(words[0]))


def scope(text: Column) -> Column:
    """NR20."""
    raw = F.lower(blank(text))
    masked = reduce(lambda acc, m: F.replace(acc, F.lit(m[0]), F.lit(m[1])), MASK, raw)

    def of(t: Column) -> Column:
        s_only, i_only, s, i = _has(t, SUPPLY_ONLY), _has(t, INSTALL_ONLY), _has(t, SUPPLY), _has(t, INSTALL)
        return (
            F.when(F.trim(raw) == "", "Generic").when(_has(raw, DISMANTLE), "Dismantle").when(s_only & ~i_only, "SupplyOnly").when(i_only & ~s_only, "InstallOnly")
            .when(_has(t, DUAL) | (s & i), "SupplyAndInstall").when(s, "SupplyOnly").when(i, "InstallOnly").otherwise("Generic")
        )

    return let(masked, of)


def scope_multiplier(a: Column, b: Column) -> Column:
    """NR21: 0 for scopes that exclude each other."""
    generic = (a == "Generic") | (b == "Generic")
    out = F.when(generic, 1.0).when(a == b, 1.05).when((a == "Dismantle") | (b == "Dismantle"), 0.0)
    out = out.when(a.isin("SupplyOnly", "InstallOnly") & b.isin("SupplyOnly", "InstallOnly"), 0.0)
    for (p, q), v in SCOPE_PENALTY.items():
        out = out.when(((a == p) & (b == q)) | ((a == q) & (b == p)), v)
    return out.otherwise(1.0)


def detect_currency(x: Column) -> Column:
    """NR26: the first sign decides, else words in order."""
    t = F.lower(blank(x))
    sign = F.regexp_extract(t, "[$€£]", 0)
    out = F.when(sign == "$", "USD").when(sign == "€", "EUR").when(sign == "£", "GBP")
    for code, words in CURRENCIES:
        out = out.when(t.rlike(words), code)
    return out.otherwise("Unknown")


def resolve_currency(*texts: Column) -> Column:
    """NR27."""
    return F.coalesce(*[F.nullif(detect_currency(t), F.lit("Unknown")) for t in texts], F.lit("EGP"))


def rate_of(code: Column, rates: dict[str, str] | None = None) -> Column:
    """Rate of a currency against the base; 1 if it is not known."""
    table = rates or RATES
    return F.coalesce(F.element_at(F.create_map(*[v for k, r in table.items() for v in (F.lit(k), F.lit(r).cast("decimal(10,2)"))]), code), F.lit("1.00").cast("decimal(10,2)"))


def convert(amount: Column, a: Column, b: Column) -> Column:
    """NR28 and NR30, as doubles."""
    known = (a != "Unknown") & (b != "Unknown") & (a != b)
    return F.when(known, amount.cast("double") * rate_of(a).cast("double") / rate_of(b).cast("double")).otherwise(amount.cast("double"))


def drift_currency(a: Column, b: Column) -> Column:
    """NR29: the first foreign currency whose parity is near the ratio of two positive rates; null for none."""
    x, y = a.cast("double"), b.cast("double")
    r = F.greatest(x, y) / F.least(x, y)
    out = F.when((x <= 0) | (y <= 0), F.lit(None).cast("string"))
    for c in FOREIGN:
        out = out.when(F.abs(r - float(RATES[c])) / float(RATES[c]) < DRIFT, c)
    return out


def non_bill(sheet: Column) -> Column:
    """FL1: sheets the readers skip."""
    s = _low(sheet)
    return F.when(s == "", True).when(s.rlike(BILL_START), s.rlike(GRAND)).otherwise(s.rlike(NON_BILL))


def non_bill_broad(sheet: Column) -> Column:
    """FL2: sheets the inspector skips."""
    s = _low(sheet)
    return (s == "") | s.rlike(NON_BILL_BROAD)


def pivot_cell(x: Column) -> Column:
    """FL3, per cell."""
    return F.lower(blank(x)).rlike(PIVOT)


def metadata_row(code: Column, text: Column) -> Column:
    """FL4."""
    return _low(code).rlike(METADATA_CODE) | _low(text).rlike(METADATA_TEXT)


def trade(text: Column) -> Column:
    """AG8: the first trade whose words occur."""
    t = F.lower(blank(text))
    out = F.when(F.lit(False), "")
    for name, words in TRADES:
        out = out.when(t.rlike(words), name)
    return out.otherwise(OTHER_TRADE)


def file_role(name: Column, priced: Column, metadata: Column) -> Column:
    """AG27."""
    n = F.lower(blank(name))
    return F.when(priced <= 0, "ConsultantTarget").when(n.rlike(CONTRACTOR) & ~n.rlike(UNPRICED), "ContractorPriced").when(n.rlike(CONSULTANT) | metadata, "ConsultantTarget").otherwise("ContractorPriced")
