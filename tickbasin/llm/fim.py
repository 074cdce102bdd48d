"""Fill-in-the-middle transformation by escaped marker injection, in SQL functions only.

A delimiter that the escaped text cannot hold is put after every unit by one
regexp_replace; the bytes that it added count the units, and substring_index
gives prefix, middle and suffix by the ranks of the delimiters around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty

#: The delimiter, the escape character, and what stands for them in an escaped text.
DELIMITER, ESCAPE = "\x01", "\x02"
ESCAPES = ((ESCAPE, ESCAPE + "b"), (DELIMITER, ESCAPE + "a"))
#: A unit: white space and the word behind it, or the white space at the end.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    """The text without delimiters."""
    for plain, stand_in in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(stand_in))
    return text


def unescaped(marked: Column) -> Column:
    """The text of a part of a marked text."""
    marked = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    for plain, stand_in in reversed(ESCAPES):
        marked = F.replace(marked, F.lit(stand_in), F.lit(plain))
    return marked


def last_parts(marked: Column, n: Column) -> Column:
    """The part behind the n-th delimiter from the end; of fewer delimiters all."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), (-n).cast("int"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "42", rate: int = 50, spm: int = 80) -> DataFrame:
    """Each text cut into prefix, middle and suffix at units drawn by its id, and put in a new order.

    rate percent of the texts are transformed, and spm percent of those put the
    suffix first.  Returns id, n (units), form (plain, psm or spm), prefix,
    middle and suffix (null if plain) and output.  Null and empty texts and
    those that hold a marker are plain; a null id draws as an empty one would;
    very long texts are cut whole; equal draws give an empty middle; repeated
    rows give repeated rows; other columns, whatever their names, are not read;
    an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.withColumns({"h": F.array(*h), "escaped": escaped(F.col("text"))})
    rows = rows.withColumn("marked", F.regexp_replace("escaped", UNIT, "$0" + DELIMITER))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length("escaped")).cast("long"))
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | holds | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    cuts = [F.col("h")[k] % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumns({"form": form, "low": F.least(*cuts), "high": F.greatest(*cuts)}).drop("h", "escaped")
    is_plain = F.col("form") == "plain"
    until_high = F.call_function("substring_index", F.col("marked"), F.lit(DELIMITER), F.col("high").cast("int"))
    rows = rows.withColumn("until_high", F.when(~is_plain, until_high))
    parts = {
        "prefix": F.call_function("substring_index", F.col("marked"), F.lit(DELIMITER), F.col("low").cast("int")),
        "middle": last_parts(F.col("until_high"), F.col("high") - F.col("low")), "suffix": last_parts(F.col("marked"), F.col("n") - F.col("high") + 1),
    }
    rows = rows.select("id", "n", "form", "text", *[F.when(~is_plain, unescaped(part)).alias(name) for name, part in parts.items()])
    orders = {"psm": (PREFIX, "prefix", SUFFIX, "suffix"), "spm": (SUFFIX, "suffix", PREFIX, "prefix")}
    output = F.when(is_plain, F.col("text"))
    for name, (first, a, second, b) in orders.items():
        output = output.when(F.col("form") == name, F.concat(F.lit(first), a, F.lit(second), b, F.lit(MIDDLE), "middle"))
    return rows.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text") -> DataFrame:
    """Adds the original text, rebuilt from output and form alone.

    Null outputs give null.  No marker can arise across a border of parts, so
    the first of each is the one that was put in.  If the table has a column of
    the new one's name, the new one gets underscores.
    """
    name = fresh(rows, text_col)
    output, form = F.col(f"`{output_col}`"), F.col(f"`{form_col}`")

    def between(first: str, second: str) -> tuple[Column, Column]:
        """What stands between the two markers, and behind the second up to the middle's."""
        head = F.call_function("substring_index", output, F.lit(MIDDLE), F.lit(1))
        return F.substr(F.call_function("substring_index", head, F.lit(second), F.lit(1)), F.lit(len(first) + 1)), F.call_function("substring_index", head, F.lit(second), F.lit(-1))

    middle = F.call_function("substring_index", output, F.lit(MIDDLE), F.lit(-1))
    prefix, suffix = between(PREFIX, SUFFIX)
    behind, before = between(SUFFIX, PREFIX)
    text = F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, middle, behind)).otherwise(output)
    return rows.withColumn(name, text)
