"""Encodings in text: Base64 sweeps and columns, escape census, unescaping."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pieces

#: Least length of a Base64 token in a sweep; ours.
B64_LEAST = 24
# Forms of escapes, as Java patterns.
FORMS = {
    "unicode": r"(?<!\\)\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})",
    "es6": r"(?<!\\)\\u\{[0-9a-fA-F]{1,8}\}",
    "double": r"\\\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|u\{[0-9a-fA-F]{1,8}\})",
    "percent": r"%u[0-9a-fA-F]{4}",
    "codepoint": r"\bU\+[0-9a-fA-F]{1,6}\b",
    "html": r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});",
}


def b64_sweep(docs: DataFrame, least: int = B64_LEAST, wrapped: bool = False) -> DataFrame:
    """Tokens of either Base64 alphabet with their bytes; `text_ok` if they are UTF-8.

    wrapped: white space inside tokens that are broken over lines (64 or 76 characters each but the last) is taken out
    first. Only at white space the pattern looks back.
    """
    text = F.regexp_replace("text", r"(?=[ \t\r\n])(?<=(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_-]{64}|[A-Za-z0-9+/_-]{76}))[ \t]*\r?\n[ \t]*(?=[A-Za-z0-9+/_=-])", "") if wrapped else F.col("text")
    token = F.explode(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{{least},}}={{0,2}}(?![A-Za-z0-9+/_=-])"), F.lit(0)))
    bare = F.rtrim(F.translate("token", "-_", "+/"), F.lit("="))
    rows = docs.select("doc_id", token.alias("token")).withColumn("bare", bare).filter(F.length("bare") % 4 != 1)
    padded = F.concat("bare", F.repeat(F.lit("="), ((4 - F.length("bare") % 4) % 4).cast("int")))
    data = rows.withColumn("data", F.try_to_binary(padded, F.lit("base64"))).filter("data is not null")
    return data.select("doc_id", "token", F.contains("token", F.lit("-")).alias("_d"), F.length("data").alias("bytes"), F.is_valid_utf8(F.col("data").cast("string")).alias("text_ok"), F.lower(F.hex("data")).alias("hex")).drop("_d")


def b64_encode(column: Column, charset: str = "UTF-8", urlsafe: bool = False, wrap: int = 0) -> Column:
    """A column in Base64, of a charset and alphabet, in lines of `wrap` characters if that is above 0."""
    out = F.regexp_replace(F.base64(F.encode(column, charset)), r"[\r\n]", "")
    out = F.translate(out, "+/", "-_") if urlsafe else out
    return F.regexp_replace(out, f"(.{{{wrap}}})(?=.)", "$1\n") if wrap > 0 else out


def escape_census(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Values with each form of escape, and the escapes, by a grouping column."""
    forms = F.array(*(F.struct(F.lit(n).alias("form"), F.coalesce(F.regexp_count(column, F.lit(p)), F.lit(0)).alias("n")) for n, p in FORMS.items()))
    each = rows.select(by, F.explode(forms).alias("x"))
    return each.groupBy(by, F.col("x.form").alias("form")).agg(F.count_if(F.col("x.n") > 0).alias("values"), F.sum("x.n").alias("n"))


_DOUBLE = re.compile(r"\\(?=\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|u\{[0-9a-fA-F]{1,8}\}))")
_ONE = {"es6": r"\\u\{([0-9a-fA-F]{1,8})\}", "unicode": r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})", "percent": r"%u([0-9a-fA-F]{4})", "codepoint": r"\bU\+([0-9a-fA-F]{1,6})\b", "html": r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));"}


def unescaped(text: str, mode: str = "auto", passes: int = 3) -> str:
    """A value without escapes of one form or of all (`auto`, which takes one double backslash off); ValueError beyond U+10FFFF."""
    def one(m: re.Match) -> str:
        code = int(m[1], 10) if m.re is decimal and m[1] else int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF:
            raise ValueError("beyond U+10FFFF")
        return chr(code)

    decimal = re.compile(_ONE["html"])
    if mode != "auto" and mode not in _ONE:
        raise ValueError(f"unknown mode {mode}")
    for _ in range(passes):
        new = _DOUBLE.sub("", text) if mode == "auto" else text
        for form in _ONE if mode == "auto" else (mode,):
            new = (decimal if form == "html" else re.compile(_ONE[form])).sub(one, new)
        new = new.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs written as two escapes
        if new == text:
            break
        text = new
    return text


def unescape(rows: DataFrame, key: str, column: str, mode: str = "auto", passes: int = 3) -> DataFrame:
    """(key, text, error) of the rows that hold an escape; the others don't reach Python."""
    some = rows.filter(F.col(column).rlike("|".join(FORMS.values()))).select(F.col(key).cast("long"), column)

    def run(batches):
        for batch in pieces(batches):
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append((unescaped(text, mode, passes), None))
                except ValueError as e:
                    out.append((None, str(e)))
            yield pa.record_batch([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], [key, "text", "error"])

    return some.mapInArrow(run, f"{key} long, text string, error string")


STYLES = ("backslash_u", "u_plus", "html_entity", "percent_u")


def escaped(column: Column, style: str = "backslash_u", uppercase: bool = False) -> Column:
    """A column with every character beyond ASCII escaped in one of STYLES; above U+FFFF `percent_u` falls back to `\\U` and eight digits."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style}")

    def one(c: Column) -> Column:
        # of a character's UTF-32 form
        digits = F.hex(F.encode(c, "UTF-32"))
        digits = digits if uppercase else F.lower(digits)
        short = F.regexp_replace(digits, "^0{0,4}", "") if style == "u_plus" else F.regexp_replace(digits, "^0+", "")
        wide = F.length(F.regexp_replace(digits, "^0{4}", "")) > 4
        marked = {
            "backslash_u": F.when(wide, F.concat(F.lit("\\U"), digits)).otherwise(F.concat(F.lit("\\u"), F.right(digits, F.lit(4)))),
            "u_plus": F.concat(F.lit("U+"), F.when(wide, F.regexp_replace(short, "^0+", "")).otherwise(short)),
            "html_entity": F.concat(F.lit("&#x"), short, F.lit(";")),
            "percent_u": F.when(wide, F.concat(F.lit("\\U"), digits)).otherwise(F.concat(F.lit("%u"), F.right(digits, F.lit(4)))),
        }[style]
        return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(marked)

    # runs of ASCII stay whole, everything else is a piece of one character
    return F.array_join(F.transform(F.regexp_extract_all(column, F.lit(r"(?s)[\x00-\x7f]+|[^\x00-\x7f]"), F.lit(0)), one), "")


def escape_job(rows: DataFrame, key: str, column: str, style: str = "backslash_u", uppercase: bool = False) -> DataFrame:
    """(key, text, escaped_chars, input_chars, output_chars) of a column, escaped. Null stays null."""
    out = rows.select(key, F.col(column).alias("_own"), escaped(F.col(column), style, uppercase).alias("text"))
    return out.select(key, "text", F.regexp_count("_own", F.lit(r"[^\x00-\x7f]")).alias("escaped_chars"), F.length("_own").alias("input_chars"), F.length("text").alias("output_chars"))
