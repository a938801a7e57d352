"""Registered queries keep every row and value of tables unlike the driver's."""

import re

import __spark_entry__ as entry
from millrace.functions import codec

def test_escape_census_of_own_escapes(spark, tmp_path):
    texts = ["caf\\u00e9 and \\u{1F600}", r"twice \\u0041 %u0042", "quiet", None, "U+00E9 &#65; quay \\", r"\\C"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.form): (r["values"], r.n) for r in entry.queries()["t12_escape_census"](spark, str(tmp_path)).collect()}
    planted = [t.replace("qu", r"\\u0071\\u0075") + "&#x41; U+0041 %u0041" for t in texts if t is not None]
    found = {form: [len(re.findall(p, v)) for v in planted] for form, p in codec.FORMS.items()}
    assert got == {("en", form): (sum(n > 0 for n in each), sum(each)) for form, each in found.items()}
    assert got["en", "unicode"] == (1, 1) and got["en", "es6"] == (1, 1)

def test_shape_runs_keep_their_lengths(spark, tmp_path):
    parts = [("bolt 7", "Brand#12", "M 10"), ("bolt 7", "Brand#13", "M 11"), ("nut 1234", "Brand#5", "x"), (None, "Brand#123456", "90_a")]
    spark.createDataFrame(parts, "p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.shape: (r.n, r.example) for r in entry.queries()["t9_shape_runs"](spark, str(tmp_path)).collect()}
    assert got == {
        r"\w+\s+\d{1}\s+\-\s+\w+\#\d{2}\s+\-\s+\w+\s+\d{2}": (2, "bolt 7 - Brand#12 - M 10"),
        r"\w+\s+\d{4}\s+\-\s+\w+\#\d{1}\s+\-\s+\w+": (1, "nut 1234 - Brand#5 - x"),
        r"\w+\#\d{6}\s+\-\s+\d{2}\w+": (1, "Brand#123456 - 90_a"),
    }
