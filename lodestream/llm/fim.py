"""Fill-in-the-middle transformation by escaped marker injection (DataFrame functions only).

A text's units are runs of ASCII letters and single other characters.  A delimiter character that
the text may hold itself is escaped first; then a pattern appends the delimiter after each unit, so
the number of delimiters is the number of units, and ``substring_index`` takes the parts before,
between and after two ranks.  The parts are cleared of delimiters, unescaped and assembled.

Ranks and forms come from the SHA-256 of ``1:`` and the decimal id, so they depend on the id alone:
a row is transformed the same way in every run, and rows of one id and different texts draw the
same numbers.  No row meets another, so nothing is shuffled and a text of any length is one row's
work.

Defined results: a null text counts as empty; an empty text, a text that holds a marker, and the
share of ids that draw it stay as they are (form ``plain``); a null id draws as an empty id does;
repeated rows give repeated rows; further columns are carried along by ``fill_in_middle``, whose
own columns have underscores before their names where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, plain, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 ids, so many are transformed, and of 100 transformed ones, so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: The delimiter, the escape character, and what stands after an escape character for each of them.
DELIMITER, ESCAPE, IS_ESCAPE, IS_DELIMITER = "\x01", "\x02", "0", "1"
#: A unit of an escaped text; an escaped character is one unit.
UNIT = f"[A-Za-z]++|{ESCAPE}[{IS_ESCAPE}{IS_DELIMITER}]|[^A-Za-z]"


def escape(text: Column) -> Column:
    """Texts without the delimiter; ``unescape`` is its inverse."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + IS_ESCAPE)), F.lit(DELIMITER), F.lit(ESCAPE + IS_DELIMITER))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + IS_DELIMITER), F.lit(DELIMITER)), F.lit(ESCAPE + IS_ESCAPE), F.lit(ESCAPE))


def inject(text: Column) -> Column:
    """The escaped text with the delimiter after each unit."""
    return F.regexp_replace(escape(text), UNIT, f"$0{DELIMITER}")


def joined(marked: Column) -> Column:
    """The text of some units with their delimiters."""
    return unescape(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def draws(id_: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def assemble(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of; each marker occurs once in an output that is not plain."""
    part = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n (units), form, prefix, middle, suffix (null if plain) and output."""
    names = {k: fresh(docs, k) for k in ("n", "form", "prefix", "middle", "suffix", "output")}
    step = {k: fresh(docs, f"_fim_{k}") for k in ("text", "units", "draws", "low", "high")}
    at = {k: F.col(f"`{v}`") for k, v in (names | step).items()}
    found = docs.withColumn(step["text"], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    found = found.withColumns({step["units"]: inject(at["text"]), step["draws"]: F.array(*draws(F.col(f"`{id_col}`")))})
    found = found.withColumn(names["n"], (F.octet_length(at["units"]) - F.octet_length(F.replace(at["units"], F.lit(DELIMITER), F.lit("")))).cast("bigint"))
    cuts = [F.get(at["draws"], F.lit(k)) % (at["n"] + 1) for k in (0, 1)]
    marked = F.contains(at["text"], F.lit(PREFIX)) | F.contains(at["text"], F.lit(SUFFIX)) | F.contains(at["text"], F.lit(MIDDLE))
    stays = (at["n"] == 0) | marked | (F.get(at["draws"], F.lit(2)) % 100 >= transformed)
    first = F.get(at["draws"], F.lit(3)) % 100 < suffix_first
    found = found.withColumns({names["form"]: F.when(stays, PLAIN).when(first, SPM).otherwise(PSM), step["low"]: F.least(*cuts), step["high"]: F.greatest(*cuts)})
    parts = lambda s, k: F.call_function("substring_index", s, F.lit(DELIMITER), k.cast("int"))
    cut = {
        "prefix": joined(parts(at["units"], at["low"])),
        "middle": joined(parts(parts(at["units"], at["high"]), at["low"] - at["high"])),
        "suffix": joined(parts(at["units"], at["high"] - at["n"] - 1)),  # the last part, behind the last delimiter, is empty
    }
    found = found.withColumns({names[k]: F.when(at["form"] != PLAIN, c) for k, c in cut.items()})
    found = found.withColumn(names["output"], assemble(at["form"], at["text"], at["prefix"], at["middle"], at["suffix"]))
    return found.drop(*step.values())


def op11_marker_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(plain(table(spark, sf_dir, "documents"), "doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return found.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same by list slices, without markers in the text.
ORACLE_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    [('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS h
  FROM documents),
ranked AS (
  SELECT *, len(units)::BIGINT AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS low, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1:high], ''), '') AS middle, coalesce(array_to_string(units[high + 1:n], ''), '') AS suffix
  FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
