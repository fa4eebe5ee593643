"""Inline values of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import rules as R
from tallyforge.functions import text as T


def values(spark, f, rows):
    return [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_parse_decimal(spark):
    cases = {"١٢٥٠.٧٥": 1250.75, "۱۲۵۰.۷۵": 1250.75, "EGP 4,500.50": 4500.5, "$ 1,200": 1200, "250.00 ج.م": 250, "125,50": 125.5, "#VALUE!": 0, "#N/A": 0, "Rate only": 0, "بند محمل": 0, "-": 0, "": 0, None: 0, "abc": 0, "nil": 0, "12%": 12}
    assert [float(v) for v in values(spark, T.parse_decimal, cases)] == list(map(float, cases.values()))


def test_parse_positive(spark):
    assert [v and float(v) for v in values(spark, T.parse_positive, ["1,200", "$5", "0", "-3", "x", None, "٥"])] == [1200, 5, None, None, None, None, None]


def test_bill_codes(spark):
    cases = {"01 - Earthworks": "01", "Bill 02A - 3BR Villa East": "02A", "Bill 06.1J - 6Plex TH East PS": "06.1J", "الباب الأول": "1", "الباب الثاني": "2", "الباب السادس": "6", "الباب 1 أعمال": "1", "Grand Summary": "-", "": "-"}
    assert values(spark, lambda x: T.bill_code(x, ~R.non_bill_broad(x)), cases) == list(cases.values())


def test_non_bill(spark):
    assert values(spark, R.non_bill, ["Bill 01 - Summary of Earthworks", "Schedule 2", "Grand Summary", "ملخص عام للمشروع", "Table of Contents", "", None]) == [False, False, True, True, True, True, True]


@pytest.mark.parametrize("a,b", [("m2", "sqm"), ("sq.m", "م2"), ("m3", "cum"), ("cu.m", "م3"), ("m", "lm"), ("lin.m", "م.ط"), ("item", "nr"), ("no", "عدد"), ("ton", "tonne"), ("طن", "ton")])
def test_unit_variants(spark, a, b):
    assert spark.range(1).select(R.units_compatible(F.lit(a), F.lit(b)).alias("v")).first().v


def test_units(spark):
    assert not spark.range(1).select(R.units_compatible(F.lit("ton"), F.lit("m3")).alias("v")).first().v
    assert values(spark, R.dimension, ["Sq.m", "cum", "lin.m", "kg", "L.S", "nr", "month", "kVA", "?"]) == ["Area", "Volume", "Length", "Weight", "LumpSum", "Count", "Time", "Power", "Unknown"]
    assert spark.range(1).select(R.quantity_score(F.lit(5.0), F.lit(5000.0)).alias("v")).first().v >= 0.90


def test_currencies(spark):
    assert values(spark, R.detect_currency, ["$ 500.00", "Rate in EUR", "50,000 ج.م", "x"]) == ["USD", "EUR", "EGP", "Unknown"]
    r = spark.range(1).select(R.drift_currency(F.lit(4850.0), F.lit(100.0)).alias("d"), R.convert(F.lit(100), F.lit("USD"), F.lit("EGP")).alias("c")).first()
    assert (r.d, r.c) == ("USD", 4850.0)


def test_tokens(spark):
    a, b = "Supply and install 16mm PVC insulated copper cables", "Supplying and installation of 16 mm PVC copper cable"
    r = spark.range(1).select(T.stemmed_tokens(F.lit(a)).alias("a"), T.stemmed_tokens(F.lit(b)).alias("b")).select(T.coverage(F.col("a"), F.col("b")).alias("c"), T.jaccard(F.col("a"), F.col("b")).alias("j")).first()
    assert r.c >= 0.70 and r.j >= 0.50


def test_scopes(spark):
    cases = {
        "Supply of Main Access Control Panel": "SupplyOnly", "furnish valves": "SupplyOnly", "توريد كابلات": "SupplyOnly", "Install, testing, commissioning": "InstallOnly", "Installation of Power Supply unit": "InstallOnly", "تركيب فقط": "InstallOnly",
        "Supply and install pipes": "SupplyAndInstall", "توريد وتركيب": "SupplyAndInstall", "Dismantle existing wall": "Dismantle", "فك وإزالة": "Dismantle", "Excavation": "Generic", "": "Generic",
    }
    assert values(spark, R.scope, cases) == list(cases.values())


def test_descriptions(spark):
    assert values(spark, T.normalise_description, ["C35/45  Concrete!", "إنشاءَات الأولى", None]) == ["c3545 concrete", "انشاءات الاولي", ""]
    assert [x for x in values(spark, lambda x: T.column_letter(x.cast("int")), ["1", "26", "27", "702"])] == ["A", "Z", "AA", "ZZ"]
    assert values(spark, T.bill_tag, ["bill02a", "x05", "infraworks", "الباب3", "q"]) == ["2a", "5", "infra", "3", ""]


def test_levenshtein(spark):
    assert spark.range(1).select(F.levenshtein(F.lit("kitten"), F.lit("sitting")).alias("v")).first().v == 3


def test_file_size_halves(spark):
    """Halves go to the even digit, as the SQL's printf has it."""
    cases = {"1023": "1023 B", "2560": "2 KB", "3584": "4 KB", "2561": "3 KB", "1310720": "1.2 MB", "1835008": "1.8 MB", "1048576": "1.0 MB", "1310721": "1.3 MB"}
    assert values(spark, lambda x: T.file_size(x.cast("bigint")), cases) == list(cases.values())
